import numpy as np
import pytest

from gristmill.llm import forest_search as S

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=10):
    out = []
    x = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    for q in sorted(i for i in x if i % every == 0):
        d = sorted((float(np.sqrt(np.square(v - x[q]).sum())), i) for i, v in x.items() if i != q)[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(d, 1)]
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], SCHEMA)


def test_recall_of_the_query(spark):
    from gristmill.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 100)}
    got = QUERIES["op9_projection_forest"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9
    exact = {(q, i): s for q, _, i, s in brute(rows, 100, 499)}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in got)


def test_copies_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300)] + [(1000, [0.0, 2.0, 0.0]), (1001, [0.0, 2.0, 0.0])]
    got = [tuple(r) for r in S.search(make(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 100)
    few = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (2, [5.0, 6.0])]
    assert [tuple(r) for r in S.search(make(spark, few)).orderBy("rank").collect()] == brute(dict(few).items(), 100)


def test_blocks_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8)) for i in range(400)]
    monkeypatch.setattr(S, "GOAL", 1.0)
    want = sorted(tuple(x) for x in S.search(make(spark, rows), every=40).collect())
    for home, most, block in ((7, 64, 7), (4096, 0, 8192), (4096, 0, 7)):  # blocks of vectors, runs of leaves, split runs
        monkeypatch.setattr(S, "HOME", home)
        monkeypatch.setattr(S, "HOME_BLOCKS", most)
        monkeypatch.setattr(S, "BLOCK", block)
        assert sorted(tuple(x) for x in S.search(make(spark, rows), every=40).collect()) == want


def test_shared_queue_visits_every_leaf_once():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6))
    f = S.Forest([S.Tree(x.astype(np.float32), np.random.default_rng(i)) for i in range(3)])
    keys = list(f.walk(x[0]))
    assert len(keys) == len(set(keys)) == f.leaves and {b for a, b in keys[:3]} == {int(t.route(x[:1])[0]) for t in f.trees}
    assert f.calibrate(x[:1], [x[:1]]) == 1 or f.trees[0].route(x[:1])[0] == keys[0][1]


def test_clustered_vectors_need_few_distances(spark, monkeypatch):
    """Around well apart centres a query must not be held against more than a tenth of the table."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 12)) * 10
    rows = [(i, centres[i % 60] + r.normal(size=12)) for i in range(3000)]
    held = spark.sparkContext.accumulator(0)
    plain = S.nearest

    def counted(q, query_id, x, ids, k):
        held.add(len(x))
        return plain(q, query_id, x, ids, k)

    monkeypatch.setattr(S, "nearest", counted)
    want = {(q, i) for q, _, i, _ in brute(rows, 100)}
    got = {(x.query_id, x.vec_id) for x in S.search(make(spark, rows)).collect()}
    assert len(got & want) / len(want) >= 0.9 and held.value / 30 < 3000 * 0.1


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [None, 1.0]), (500, [1.0]), (600, [inf, 1.0]), (None, [1.0, 2.0]), (7, [2.0, 2.0]), (8, [])]
    got = [(r.query_id, r.rank, r.vec_id) for r in S.search(make(spark, rows)).collect()]
    assert got == [(0, 1, 7)]
    assert S.search(make(spark, [])).count() == 0 and S.search(make(spark, [(0, None)])).count() == 0
    clash = make(spark, [(0, [1.0, 1.0]), (1, [1.0, 2.0])]).selectExpr("*", "1 AS v", "2 AS ids", "3 AS score")
    assert S.search(clash).count() == 1
