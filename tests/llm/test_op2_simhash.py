import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import components as C
from gristmill.llm import simhash as S


def reference(data):
    words = data.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def linked(values):
    """value -> smallest value reachable over links of at most 3 bits, by comparing all pairs."""
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint(monkeypatch):
    texts = [b"", b" \t\x0b", b"One", b"One TWO", b"one two three", b"a b c d e " * 40, "É é ß word".encode(), b"x " * 50]
    for t in texts:
        assert S.fingerprint(t) == reference(t)
    monkeypatch.setattr(S, "CHUNK", 7)
    for t in texts:
        assert S.fingerprint(t) == reference(t)


def test_masks_cover_every_close_pair():
    r, masks = random.Random(2), S.block_masks()
    for _ in range(500):
        flips = sum(1 << i for i in r.sample(range(64), r.randint(0, 3)))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("hot", [256, 1])
def test_components_equal_all_pairs(spark, hot):
    r, values = random.Random(3), set()
    for _ in range(12):
        base = r.getrandbits(64)
        values.add(base)
        for _ in range(12):
            values.add(base ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))))
    want = linked(sorted(values))
    rows = spark.createDataFrame([(i, S.signed(v)) for i, v in enumerate(sorted(values))], "doc_id long, fp long")
    got = {}
    for fp, component in S.fingerprint_components(rows, F.col("doc_id"), hot).collect():
        got.setdefault(component, set()).add(fp)
    groups = {}
    for v, root in want.items():
        groups.setdefault(root, set()).add(S.signed(v))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (50, 200), (200, 60), (60, 50)]
    got = dict(C.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100 and got[50] == got[60] == got[200] == 50
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark, make, awkward, empty, clashing):
    got = S.near_duplicates(awkward).collect()
    assert len(got) == 10
    zero = {(r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16}
    assert zero == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert S.near_duplicates(empty).count() == 0 and S.near_duplicates(clashing).count() == 3
    assert [r.component_id for r in S.near_duplicates(make([(None, "a b c d")])).collect()] == [None]
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert S.keep_one(empty).count() == 0 and S.keep_one(clashing).columns == clashing.columns


def test_query_equals_brute_force(spark, sf):
    from gristmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: reference(t.encode()) for i, t in texts.items()}
    root = linked(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_blocks"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def test_rounds_over_few_links_take_few_tasks(spark):
    """A round's tasks follow the counted links, not the partitions that they lie in."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        edges = spark.range(200).selectExpr("id + 1 AS u", "id AS v").repartition(50)
        assert {r.root for r in C.components(edges).collect()} == {0}
        at = sc.statusTracker()
        stages = {s for j in at.getJobIdsForGroup("few links") for s in at.getJobInfo(j).stageIds}
        assert sum(i.numCompletedTasks for i in map(at.getStageInfo, stages) if i) < 1000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
