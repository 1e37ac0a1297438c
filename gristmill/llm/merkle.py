"""Merkle manifest of a table: a tree of digests per group, a root over the groups, a proof for every row.

Leaves are hashed by Spark, written once in narrow form, and range-sorted by (group, key). A sorted
partition knows where it lies in its groups from counts alone: only the first group of a partition can
have begun in an earlier one, so one offset a partition is all the driver holds. Each partition then
builds the complete aligned subtrees over its own leaves in one streaming pass and hands on their
roots, at most two a level for a group that crosses its borders. These ragged nodes are shuffled by the
coordinate of an ancestor some levels up, the levels between are finished there, and so on until each
group has one node. The groups' roots are the leaves of one more tree, built in the same way. For the
proofs, each subtree root gets its path to the top, and partitions add the path below it.

H is the lowercase hex SHA-256 of digests concatenated as hex text; two consecutive nodes (the last
of a level may be alone) become their parent, until one node remains. A leaf hashes its fields, each
as `-` if null, else its UTF-8 byte count, `:` and its value.

Edge cases: null keys come first, as a group of their own if the group is null; rows equal in all
columns are leaves of equal digest, one after the other; a group of one leaf has that leaf as subroot;
texts may be empty or long; an empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import cut, ship

ship(__name__)

#: Leaves that a sorted partition holds at most by intent, and at least before there are as many partitions as Spark shuffles to.
LEAVES, FEWEST = 262_144, 4_096
#: Levels finished in one shuffle of ragged nodes, and by how many more than a partition's own the first one goes up.
HEIGHT, ABOVE = 12, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "g string, first long, total long, top int, part int, level int, at long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: str, right: str = "") -> str:
    return digest(left + right)


def depth(total: int) -> int:
    """Levels above the leaves of a tree with `total` leaves."""
    return max(total - 1, 0).bit_length()


def width(total: int, level: int) -> int:
    """Nodes at a level of that tree."""
    return -(-total >> level)


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row with these values."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def local_roots(first: int, digests, total: int) -> list[tuple[int, int, str]]:
    """(level, at, digest) of the largest complete subtrees over the leaves `first`, `first` + 1, ... of a group of `total`, in order."""
    stack: list[tuple[int, int, str]] = []

    def settle() -> None:
        while len(stack) > 1 and stack[-1][1] & 1 and stack[-2][:2] == (stack[-1][0], stack[-1][1] - 1):
            (level, at, right), (_, _, left) = stack.pop(), stack.pop()
            stack.append((level + 1, at >> 1, parent(left, right)))

    n = first
    for d in digests:
        stack.append((0, n, d))
        n += 1
        settle()
    top = depth(total)
    while n == total and stack and stack[-1][0] < top and not stack[-1][1] & 1:  # the last of a level, alone
        level, at, d = stack.pop()
        stack.append((level + 1, at >> 1, parent(d)))
        settle()
    return stack


def levels_of(first: int, digests: list[str], total: int) -> list[tuple[int, list[str]]]:
    """By level: the place of the first node whose subtree lies within these leaves, and the digests from there on."""
    out = [(first, digests)]
    for level in range(depth(total)):
        at, row = out[-1]
        skip = at & 1
        ups = [parent(row[i], row[i + 1]) for i in range(skip, len(row) - 1, 2)]
        if (len(row) - skip) & 1 and at + len(row) == width(total, level):
            ups.append(parent(row[-1]))
        if not ups:
            break
        out.append(((at + skip) >> 1, ups))
    return out


def step(at: int, beside: str | None) -> str:
    """One level of a proof: on which side of the node at `at` its sibling stands, and the sibling; `-` without one."""
    return "-" if beside is None else ("L" if at & 1 else "R") + beside


def paths(first: int, digests: list[str], total: int, above: dict):
    """The proof of each leaf: its steps up to a subtree root of `above` {(level, at): steps}, then that root's."""
    levels = levels_of(first, digests, total)
    for at in range(first, first + len(digests)):
        out, level = [], 0
        while (level, at) not in above:
            start, row = levels[level]
            beside = at ^ 1
            out.append(step(at, row[beside - start] if beside < width(total, level) else None))
            at, level = at >> 1, level + 1
        yield ",".join([x for x in (*out, above[level, at]) if x])


def fold(d: str, proof: str) -> str:
    """The root that follows from a leaf's digest and its proof."""
    for x in proof.split(",") if proof else ():
        d = parent(d) if x == "-" else parent(x[1:], d) if x[0] == "L" else parent(d, x[1:])
    return d


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def ordered(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """`leaves` (g, keys, ..., digest), written in range-sorted partitions: with part, its number, and place, ascending within it.

    Equal rows may be dealt to several partitions: their place in the written input tells them apart.
    """
    leaves = leaves.withColumn("place", F.monotonically_increasing_id())
    n = leaves.count()
    shuffles = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(n / LEAVES), min(shuffles, n // FEWEST))
    by = ["g", *keys, "digest", "place"]
    return cut(leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def offsets(rows: DataFrame) -> tuple[dict, int, int]:
    """From counts: {part: (first group, its leaves in earlier partitions, its total, last group, its total)}, the largest partition's leaves and the largest group's."""
    runs = rows.groupBy("part", "g").agg(F.count("*").alias("n"))
    ends = runs.groupBy("part").agg(F.min(F.struct("g", "n")).alias("low"), F.max(F.struct("g", "n")).alias("high"), F.sum("n").alias("all")).collect()
    totals: dict[str, int] = {}
    before = {}
    for r in sorted(ends, key=lambda r: r["part"]):
        (low, n), (high, m) = r["low"], r["high"]
        before[r["part"]] = totals.get(low, 0)
        totals[low] = before[r["part"]] + n
        if high != low:
            totals[high] = m
    plan = {r["part"]: (r["low"]["g"], before[r["part"]], totals[r["low"]["g"]], r["high"]["g"], totals[r["high"]["g"]]) for r in ends}
    held = max((r["all"] for r in ends), default=0)
    return plan, held, max([held, *totals.values()])


def roots(rows: DataFrame, plan: dict) -> DataFrame:
    """`NODE`: the largest complete subtrees of every partition; first is its first leaf's place in the group, top the depth of the group's tree."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        out, seen, now, part = [], [], None, None

        def close() -> None:
            low, before, low_total, high, high_total = shared.value[part]
            first, total = (before, low_total) if now == low else (0, high_total if now == high else len(seen))
            out.extend((now, first, total, depth(total), part, *node) for node in local_roots(first, seen, total))
            seen.clear()

        for g, part_here, d in _rows(batches):
            if now is not None and g != now:
                close()
                if len(out) > 10_000:
                    yield from _arrow(out, NODE).to_batches()
                    out.clear()
            now, part = g, part_here
            seen.append(d)
        if now is not None:
            close()
        yield from _arrow(out, NODE).to_batches()

    return rows.select("g", "part", "digest").mapInArrow(run, NODE)


def climb(nodes: DataFrame, ceiling: int, largest: int) -> DataFrame:
    """`nodes` with steps, their path up to the group's root, and subroot, its digest.

    Nodes below their group's root meet by their ancestor at level `ceiling`; the levels up to it are finished there.
    """
    done = nodes.where("level = top").select("*", F.lit("").alias("steps"), F.col("digest").alias("subroot"))
    if ceiling - HEIGHT >= depth(largest):
        return done
    schema = f"{NODE}, near string, up_level int, up_at long, up_digest string, lead boolean"
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table.select(names).to_batches()))
        total, top = rows[0][2], min(ceiling, rows[0][3])
        have = {(r[5], r[6]): r[7] for r in rows}
        by_level: dict[int, list[int]] = {}
        for level, at in have:
            by_level.setdefault(level, []).append(at)
        for level in range(min(by_level), top):
            for at in by_level.get(level, ()):
                if not at & 1:
                    have[level + 1, at >> 1] = parent(have[level, at], have[level, at + 1] if at + 1 < width(total, level) else "")
                    by_level.setdefault(level + 1, []).append(at >> 1)
        out = []
        for i, r in enumerate(rows):
            steps, at = [], r[6]
            for level in range(r[5], top):
                steps.append(step(at, have[level, at ^ 1] if at ^ 1 < width(total, level) else None))
                at >>= 1
            out.append((*r, ",".join(steps), top, at, have[top, at], i == 0))
        return _arrow(out, schema)

    block = F.expr(f"shiftright(at, least({ceiling}, top) - level)")
    met = cut(nodes.where("level < top").withColumn("block", block).groupBy("g", "block").applyInArrow(run, schema))
    leads = met.where("lead").select("g", "first", "total", "top", "part", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_digest").alias("digest"))
    upper = climb(leads, ceiling + HEIGHT, largest).select("g", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("steps").alias("far"), "subroot")
    joined = met.join(upper, ["g", "up_level", "up_at"])
    return done.unionByName(joined.select(*names, joined_steps("near", "far").alias("steps"), "subroot"))


def joined_steps(*names: str) -> Column:
    return F.concat_ws(",", *(F.nullif(F.col(n), F.lit("")) for n in names))


def proofs(rows: DataFrame, nodes: DataFrame, carried: str) -> DataFrame:
    """The columns `carried` (a schema) of `ordered` rows with proof, subroot and root, from `nodes` (`climb`'s with root): each partition meets its own subtree roots only."""
    names = [x.split()[0] for x in carried.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trees: dict[str, tuple] = {}
        for g, first, total, subroot, root, level, at, steps in _rows(right.select(["g", "first", "total", "subroot", "root", "level", "at", "steps"]).to_batches()):
            trees.setdefault(g, (first, total, subroot, root, {}))[-1][level, at] = steps
        left = left.sort_by("place")
        digests: dict[str, list[str]] = {}
        for g, d in _rows(left.select(["g", "digest"]).to_batches()):
            digests.setdefault(g, []).append(d)
        found = []
        for g, own in digests.items():  # groups are in order, as the rows are
            first, total, subroot, root, above = trees[g]
            found += [(p, subroot, root) for p in paths(first, own, total, above)]
        more = _arrow(found, "proof string, subroot string, root string")
        return pa.table([*left.select(names).columns, *more.columns], names=[*names, *more.column_names])

    return rows.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(run, f"{carried}, proof string, subroot string, root string")


def tree(leaves: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`ordered` rows, `climb`'s nodes) of leaves (g, keys, ..., digest)."""
    rows = ordered(leaves, keys)
    plan, held, largest = offsets(rows)
    return rows, climb(cut(roots(rows, plan)), depth(held) + ABOVE, largest)


def prove(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, lang, leaf, subroot, root and proof: steps from leaf to root, L or R with the sibling on that side, `-` where there is none.

    Also altered: the leaf that the row would have with n_chars one higher, where 7 divides the CRC-32 of its decimal doc_id, else the leaf.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    values = [F.col(c) for c in FIELDS]
    other = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    group = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    leaves = docs.select(group.alias("g"), "doc_id", leaf(values).alias("digest"), F.when(chosen, leaf(other)).alias("altered"))
    rows, nodes = tree(cut(leaves), ["doc_id"])
    nodes = cut(nodes)
    subroots = nodes.dropDuplicates(["g"]).select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("digest"))
    top_rows, top_nodes = tree(cut(subroots), ["key"])
    tops = proofs(top_rows, top_nodes.withColumn("root", F.col("subroot")), "key string").select(F.col("key").alias("g"), F.col("proof").alias("to_root"), "root")
    whole = nodes.join(tops, "g").withColumn("steps", joined_steps("steps", "to_root"))
    given = proofs(rows, whole, "g string, doc_id long, digest string, altered string")
    lang = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    return given.select("doc_id", lang.alias("lang"), F.col("digest").alias("leaf"), "subroot", "root", "proof", F.coalesce("altered", "digest").alias("altered"))


def verified(proved: DataFrame) -> DataFrame:
    """`prove`'s rows with folded_root, recomputed from the altered leaf and the proof, and whether it is the root."""
    schema = "doc_id long, lang string, leaf string, subroot string, root string, proof string, altered string, folded_root string"

    def run(batches):
        for batch in batches:
            folded = [fold(d, p) for p, d in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    return proved.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings, concatenated in the proof's order), folded_root, verified, lang."""
    siblings = F.regexp_replace("proof", "[LR,-]", "")
    return verified(prove(docs)).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified", "lang")
