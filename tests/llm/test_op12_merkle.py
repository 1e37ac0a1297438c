import hashlib
import random
import zlib

import pytest

from gristmill.llm import merkle as M
from gristmill.llm.queries import QUERIES
from gristmill.runtime import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[c] + more if c == "n_chars" and row[c] is not None else row[c] for c in M.FIELDS]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain(rows):
    """The contract's rows by lists and loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {k: tree_of([leaf_of(r) for r in groups[k]]) for k in names}
    top = tree_of([trees[k][-1][0] for k in names])
    out = []
    for g, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded, beside = leaf_of(r, int(tampered)), []
            for levels, at in ((trees[k], i), (top, g)):
                for level in levels[:-1]:
                    run = level[at - at % 2 : at - at % 2 + 2]
                    other = run[1 - at % 2 :][:1] if at % 2 == 0 else run[:1]
                    beside += other
                    folded = h("".join([*other, folded] if at % 2 else [folded, *other]))
                    at //= 2
            out.append((r["doc_id"], leaf_of(r), trees[k][-1][0], top[-1][0], h("".join(beside)), folded, folded == top[-1][0], k))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(M, "FEWEST", 1)
    monkeypatch.setattr(M, "LEAVES", 7)


def test_query_over_the_table_equals_plain_loops(spark, sf):
    got = QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(got) == plain([r.asDict() for r in table(spark, sf, "documents").collect()])


def test_ragged_partitions_in_several_rounds_equal_plain_loops(spark, sf, small_parts, monkeypatch):
    monkeypatch.setattr(M, "HEIGHT", 2)
    monkeypatch.setattr(M, "ABOVE", 1)
    docs = table(spark, sf, "documents").drop("text").withColumnRenamed("source", "text")
    from pyspark.sql import functions as F

    docs = docs.withColumn("source", F.lit("s"))
    assert rows(M.manifest(docs)) == plain([r.asDict() for r in docs.collect()])


def test_local_roots_and_paths_for_every_cut():
    r = random.Random(3)
    for total in [*range(1, 40), 64, 65, 127]:
        leaves = [h(f"{total}:{i}") for i in range(total)]
        levels = tree_of(leaves)
        cuts = sorted({0, total, *(r.randrange(total + 1) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            above = {}
            for level, at, d in M.local_roots(a, leaves[a:b], total):
                assert levels[level][at] == d
                steps, k, x = [], level, at
                while k < M.depth(total):
                    steps.append(M.step(x, levels[k][x ^ 1] if x ^ 1 < len(levels[k]) else None))
                    x, k = x >> 1, k + 1
                above[level, at] = ",".join(steps)
            for leaf, proof in zip(leaves[a:b], M.paths(a, leaves[a:b], total, above)):
                assert M.fold(leaf, proof) == levels[-1][0] and len(proof.split(",")) == M.depth(total) + (total == 1)


def test_edges(spark, small_parts, awkward, empty, clashing):
    assert rows(M.manifest(awkward)) == plain([r.asDict() for r in awkward.collect()])
    assert rows(M.manifest(empty)) == []
    assert rows(M.manifest(clashing)) == plain([r.asDict() for r in clashing.collect()])
    one = spark.createDataFrame([(7, "alone", None, None, None)], DOC)
    assert rows(M.manifest(one)) == plain([r.asDict() for r in one.collect()])
    same = spark.createDataFrame([(5, "x", "en", "s", 1)] * 30 + [(None, None, "en", None, 2)] * 3 + [(i, "", None if i % 2 else f"l{i}", "s", None) for i in range(23)], DOC)
    assert rows(M.manifest(same)) == plain([r.asDict() for r in same.collect()])
