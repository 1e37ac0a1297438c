"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample (`SAMPLE` distinct vectors, by hash) along the line between two
random members until `LEAF` are left; every vector of the table is then indexed in the leaf it falls
into, in each tree. A query walks all trees through one shared priority queue: the open node whose
crossed hyperplanes cost least comes next, where a crossing costs the square of the margin by which
the query lies on the other side. It takes the first leaves that it reaches. How many is calibrated
on the whole table: some probes' true neighbours are found by brute force (one pass, one row per
probe and batch), and the number of leaves is the least at which `GOAL` of them are met, so clustered
vectors need few and patternless ones many. Candidates are ranked by exact double-precision distance
on the original vectors, and a group of leaves passes on its nearest only, not its pairs.

Trees are fitted on executors, one task a tree; the driver holds hyperplanes in single precision
(trees x `SAMPLE` / `LEAF` of them), which is broadcast. The index has one of two layouts, by the
counted vectors, with the same number of trees and the same candidates. Up to `HOME_BLOCKS` blocks of `HOME`
vectors, each vector lies in one block with its leaf in each tree, and a query with its leaves goes
to every block once: a candidate of several trees is ranked once, and more trees cost no copies.
Beyond that, each tree's leaves are dealt in runs of neighbouring ones of about `BLOCK` vectors, a
copy of the vectors for each tree; a query goes to the runs that hold leaves of its own, once each,
however many there are. Leaves larger than that are split into blocks, and so are their queries.

Equal vectors are indexed once, with their smallest ids: a group of copies, however large, is one
entry, and no id beyond the smallest `k` + 1 can be among anyone's nearest `k`.

Edge cases: vectors that are null, zero, of another length than the most common one, or that hold
null or non-finite components take no part, nor do rows with a null id; repeated rows count once;
ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.runtime import cut, hashed_sample, ship

ship(__name__)

SAMPLE, LEAF, SEED = 32_768, 16, 11
GOAL, PROBES = 0.935, 150
#: Trees, at every size.
TREES = 24
#: Vectors of a block, where each vector lies in one block only; and the most such blocks.
HOME, HOME_BLOCKS = 4_096, 64
#: Vectors, and queries, that a task holds of one run of leaves.
BLOCK = 8_192
SCHEMA = "query_id long, vec_id long, score double"


class Tree:
    """Hyperplanes of one tree: children >= 0 are nodes, -1 - i is leaf i; leaves count from left to right."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        normals, offsets, children, self.leaves = [], [], [], 0

        def grow(idx: np.ndarray) -> int:
            split = self.split(x, idx, rng) if len(idx) > LEAF else None
            if split is None:
                self.leaves += 1
                return -self.leaves
            me = len(normals)
            normals.append(split[0])
            offsets.append(split[1])
            children.append(None)
            left = x[idx] @ split[0] <= split[1]
            children[me] = (grow(idx[left]), grow(idx[~left]))
            return me

        self.root = grow(np.arange(len(x)))
        self.normals = np.array(normals, np.float32).reshape(-1, x.shape[1])
        self.offsets, self.children = np.array(offsets), children

    @staticmethod
    def split(x: np.ndarray, idx: np.ndarray, rng: np.random.Generator):
        """(normal, median) between two random members, or None if ten tries split nothing off."""
        for _ in range(10):
            a, b = rng.choice(len(idx), 2, replace=False)
            normal = x[idx[a]] - x[idx[b]]
            size = np.linalg.norm(normal)
            if size > 0:
                normal = (normal / size).astype(np.float32)
                p = x[idx] @ normal
                middle = np.median(p)
                if 0 < (p <= middle).sum() < len(p):
                    return normal, middle
        return None

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            if node < 0:
                out[idx] = -1 - node
            elif len(idx):
                left = x[idx] @ self.normals[node] <= self.offsets[node]
                todo += [(self.children[node][0], idx[left]), (self.children[node][1], idx[~left])]
        return out


class Forest:
    """Trees fitted on a sample, and the number of leaves that a query visits (all, until calibrated)."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.leaves = self.visits = sum(t.leaves for t in trees)

    def walk(self, q: np.ndarray):
        """(tree, leaf) in the order in which the shared queue reaches them: least sum of squared crossings first."""
        margins = [(t.normals @ q - t.offsets).tolist() for t in self.trees]
        children = [t.children for t in self.trees]
        heap = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(heap)
        while heap:
            cost, i, node = heapq.heappop(heap)
            while node >= 0:  # down on the query's own side, which costs nothing more
                m = margins[i][node]
                left, right = children[i][node]
                heapq.heappush(heap, (cost + m * m, i, right if m <= 0 else left))
                node = left if m <= 0 else right
            yield i, -1 - node

    def calibrate(self, probes: np.ndarray, neighbours: list[np.ndarray]) -> int:
        """Leaves to visit so that `GOAL` of the probes' neighbours (one array of vectors each) are met."""
        needed = []  # per probe and neighbour: the visit that first holds it
        for q, x in zip(probes, neighbours):
            if len(x):
                holds = {}
                for i, t in enumerate(self.trees):
                    for n, leaf in enumerate(t.route(x)):
                        holds.setdefault((i, int(leaf)), []).append(n)
                first = {}
                for visit, key in enumerate(self.walk(q), 1):
                    for n in holds.get(key, ()):
                        first.setdefault(n, visit)
                    if len(first) == len(x):
                        break
                needed += first.values()
        return min(self.leaves, int(np.quantile(needed, GOAL)) + 1) if needed else self.leaves


def usable(table: DataFrame) -> DataFrame:
    """vec_id and v (the vector, in the precision it came in) of the rows that take part."""
    kind = table.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and ids: its smallest k + 1 ids, sorted. Ranks are limited before the shuffle, so copies don't pile up."""
    ranked = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def nearest(q: np.ndarray, query_id: int, x: np.ndarray, ids: list, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, distance) of the k nearest rows of x other than the query's own, ties to smaller ids."""
    d = np.sqrt(np.square(x - q).sum(axis=1))
    near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
    found = sorted((d[i], vec_id) for i in near for vec_id in ids[i] if vec_id != query_id)[:k]
    return [(query_id, vec_id, float(s)) for s, vec_id in found]


def fit(sample: np.ndarray, trees: int, spark) -> Forest:
    """`trees` trees on the rows of `sample`, each grown by a task of its own from its own seed."""
    shared = spark.sparkContext.broadcast(sample.astype(np.float32))

    def grow(frames):
        for p in frames:
            for i in p["id"]:
                yield pd.DataFrame({"id": [i], "tree": [pickle.dumps(Tree(shared.value, np.random.default_rng([SEED, int(i)])).__dict__)]})

    grown = []
    for r in spark.range(0, trees, 1, trees).mapInPandas(grow, "id long, tree binary").orderBy("id").collect():
        tree = Tree.__new__(Tree)
        tree.__dict__ = pickle.loads(r.tree)
        grown.append(tree)
    return Forest(grown)


def true_neighbours(unique: DataFrame, probes: np.ndarray, k: int) -> list[np.ndarray]:
    """The k vectors of `unique` (v) nearest to each probe but not equal to it: exact, `k` per batch and probe at most."""
    shared = unique.sparkSession.sparkContext.broadcast(probes)

    def best(frames):
        for p in frames:
            if len(p):
                x = _matrix(p["v"])
                for i, q in enumerate(shared.value):
                    d = np.square(x - q).sum(axis=1)
                    d[d == 0] = np.inf
                    near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                    near = near[np.isfinite(d[near])]
                    yield pd.DataFrame({"probe": i, "d": d[near], "v": list(p["v"].iloc[near])})

    found = unique.select("v").mapInPandas(best, "probe int, d double, v array<double>")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy("d", "v"))).where(F.col("rank") <= k)
    out = [[] for _ in probes]
    for r in ranked.select("probe", "v").collect():  # probes x k rows
        out[r.probe].append(r.v)
    return [np.array(x, np.float64).reshape(len(x), probes.shape[1]) for x in out]


def search(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `table` (vec_id, embedding) whose id `every` divides."""
    spark = table.sparkSession
    rows = usable(table)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == size["n"])
    unique = cut(distinct_vectors(rows, k))
    n_unique = unique.count()
    taken = _matrix(hashed_sample(unique.select("v"), n_unique, SAMPLE).toPandas()["v"])
    blocks = -(-n_unique // HOME)
    at_home = blocks <= HOME_BLOCKS
    forest = fit(taken, TREES, spark)
    probes = taken[:: max(1, len(taken) // PROBES)][:PROBES]  # the sample comes in hash order, so these are any
    forest.visits = forest.calibrate(probes, true_neighbours(unique, probes, k))
    forest_leaves = forest.leaves
    shared = spark.sparkContext.broadcast(pickle.dumps({"trees": [t.__dict__ for t in forest.trees], "visits": forest.visits}))
    per_tree = max(t.leaves for t in forest.trees)
    runs = max(1, min(per_tree, round(n_unique / BLOCK)))  # runs of neighbouring leaves a tree
    width = -(-per_tree // runs)

    def held() -> Forest:
        parts = pickle.loads(shared.value)
        trees = []
        for own in parts["trees"]:
            t = Tree.__new__(Tree)
            t.__dict__ = own
            trees.append(t)
        f = Forest(trees)
        f.visits = parts["visits"]
        return f

    def offsets(trees: list[Tree]) -> np.ndarray:
        return np.cumsum([0] + [t.leaves for t in trees])

    def index_home(frames):
        trees = held().trees
        starts = offsets(trees)
        for p in frames:
            if len(p):
                x = _matrix(p["v"])
                leaves = np.stack([t.route(x) + s for t, s in zip(trees, starts)], 1).astype(np.int32)
                yield pd.DataFrame({"block": p["block"], "leaves": list(leaves), "v": p["v"], "ids": p["ids"]})

    def ask_home(frames):
        f = held()
        starts = offsets(f.trees)
        for p in frames:
            if len(p):
                visited = [np.array([starts[i] + leaf for (i, leaf), _ in zip(f.walk(np.asarray(v, np.float64)), range(f.visits))], np.int32) for v in p["v"]]
                yield pd.DataFrame({"visited": visited, "query_id": p["vec_id"], "v": p["v"]})

    def rank_home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids, leaves = _matrix(left["v"]), left["ids"].tolist(), np.stack(left["leaves"].to_numpy())
            for query_id, v, visited in zip(right["query_id"], right["v"], right["visited"]):
                seen = np.zeros(forest_leaves, bool)
                seen[visited] = True
                at = np.flatnonzero(seen[leaves].any(axis=1))
                if len(at):
                    out += nearest(np.asarray(v, np.float64), query_id, x[at], [ids[i] for i in at], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def index(frames):
        trees = held().trees
        for p in frames:
            if len(p):
                x = _matrix(p["v"])
                for i, t in enumerate(trees):
                    leaf = t.route(x)
                    yield pd.DataFrame({"tree": i, "run": leaf // width, "leaf": leaf, "v": p["v"], "ids": p["ids"]})

    def ask(frames):
        f = held()
        for p in frames:
            for query_id, v in zip(p["vec_id"], p["v"]):
                keys = np.array([key for key, _ in zip(f.walk(np.asarray(v, np.float64)), range(f.visits))])
                place = keys[:, 0] * (per_tree // width + 1) + keys[:, 1] // width
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
                heads = keys[order[starts]]
                yield pd.DataFrame({"tree": heads[:, 0], "run": heads[:, 1] // width, "leaves": np.split(keys[order, 1], starts[1:]), "query_id": query_id, "v": [v] * len(heads)})

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("leaf", kind="stable")
            x, ids, leaf = _matrix(left["v"]), left["ids"].tolist(), left["leaf"].to_numpy()
            for query_id, v, leaves in zip(right["query_id"], right["v"], right["leaves"]):
                first, last = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
                if len(at):
                    out += nearest(np.asarray(v, np.float64), query_id, x[at], [ids[i] for i in at], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    n_queries = queries.count()
    own = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = rows.schema["v"].dataType.simpleString()
    dealt = queries.repartition(max(1, min(n_queries // 32, 4 * spark.sparkContext.defaultParallelism)), "vec_id")  # walks take time, few rows
    if at_home:
        query_blocks = n_queries // (4 * BLOCK) + 1
        indexed = unique.withColumn("block", own("v", max(1, blocks))).mapInPandas(index_home, f"block int, leaves array<int>, v {kind}, ids array<long>").withColumn("query_block", every_one(query_blocks))
        asked = dealt.mapInPandas(ask_home, f"visited array<int>, query_id long, v {kind}").withColumn("query_block", own("query_id", query_blocks)).withColumn("block", every_one(max(1, blocks)))
        found = indexed.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInPandas(rank_home, SCHEMA)
    else:
        row_blocks = int(n_unique / runs // (4 * BLOCK)) + 1
        query_blocks = int(n_queries * min(1.0, forest.visits / (runs * len(forest.trees))) // (4 * BLOCK)) + 1
        indexed = unique.mapInPandas(index, f"tree int, run long, leaf long, v {kind}, ids array<long>")
        indexed = indexed.withColumn("row_block", own("v", row_blocks)).withColumn("query_block", every_one(query_blocks))
        asked = dealt.mapInPandas(ask, f"tree int, run long, leaves array<long>, query_id long, v {kind}")
        asked = asked.withColumn("query_block", own("query_id", query_blocks)).withColumn("row_block", every_one(row_blocks))
        key = ["tree", "run", "row_block", "query_block"]
        found = indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(rank, SCHEMA)
    pairs = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
