import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from gristmill.llm import sharding as S


def draw(key, shard):
    h = xxhash.xxh64_intdigest(f"shard{shard}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return -math.log(((h >> 12) + 0.5) / 2**52)


def shard_of(doc_id, shards):
    key = "\0null" if doc_id is None else str(doc_id)
    return min(range(shards), key=lambda s: (draw(key, s), s))


def test_query_recomputed_over_the_whole_table(spark):
    from gristmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_hash_tree_shards"](spark, sf).collect()
    want = Counter((i, len(t) + 1, zlib.crc32(t), "key", shard_of(i, 16), shard_of(i, 17)) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, n) for s in sorted(sizes) for n in range(sizes[s])]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """The law for every count on the plain form, which the operator equals at several counts."""
    model = {i: [shard_of(i, n) for n in range(1, 66)] for i in range(1500)}
    assert all(at[n] in (at[n - 1], n) for at in model.values() for n in range(1, 65))
    some = (1, 2, 5, 9, 16, 17, 33, 64, 65)
    rows = spark.range(1500).withColumnRenamed("id", "doc_id")
    for r in rows.select("doc_id", *(S.descend(F.col("doc_id").cast("string"), S.grid(n))["shard"].alias(f"n{n}") for n in some)).collect():
        assert [r[f"n{n}"] for n in some] == [model[r.doc_id][n - 1] for n in some]
    for n in some:
        assert {at[n - 1] for at in model.values()} == set(range(n))


def test_grown_shard_is_the_answer_for_one_more(make):
    docs = make([(i, f"text {i}") for i in range(500)])
    grown = {r.doc_id: r.grown_shard for r in S.shard_documents(docs, 20).collect()}
    assert grown == {r.doc_id: r.shard for r in S.shard_documents(docs, 21).collect()}


def test_many_equal_rows_are_spread(make):
    docs = make([(None, "same")] * 3000 + [(i, "same") for i in range(50)]).repartition(12)
    got = S.shard_documents(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 3050 and sorted((r.shard, r.slot) for r in got) == [(s, n) for s in sorted(sizes) for n in range(sizes[s])]
    plan = S.shard_documents(docs)._jdf.queryExecution().toString()
    assert "sequence" in plan.lower()


def test_growth_moves_rows_only_into_the_new_shard(make):
    docs = make([(i, f"text {i}") for i in range(2000)])
    got = S.shard_documents(docs).collect()
    assert {r.shard for r in got} == set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and 60 < sum(r.grown_shard == 16 for r in got) < 180
    assert max(Counter(r.shard for r in got).values()) < 190
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    again = {r.doc_id: (r.shard, r.slot) for r in S.shard_documents(docs.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_weight_changes_stay_in_their_subtrees(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = S.grid(16)
    rack = S.Node(tuple(S.Shard(c.number, 3.0 if c.number == 15 else 1.0) for c in tree.children[1].children[1].children))
    heavier = S.Node((tree.children[0], S.Node((tree.children[1].children[0], rack))))
    rows = S.place(S.place(rows, tree, into="a"), heavier, into="b").collect()
    assert {r.b for r in rows if r.a != r.b} == {15}
    assert abs(sum(r.b == 15 for r in rows) / 4000 - 3 / 18) < 0.025 and abs(sum(r.b >= 8 for r in rows) / 4000 - 10 / 18) < 0.035
    unused = S.Node((S.Node((S.Node((S.Shard(0, 0.0), S.Shard(1))),)),))
    assert {r.shard for r in S.place(spark.range(50).withColumnRenamed("id", "doc_id"), unused).collect()} == {1}


def test_edges(make, awkward, empty, clashing):
    got = S.shard_documents(awkward).collect()
    assert len(got) == 10
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16
    null = [r for r in got if r.doc_id == 1][0]
    assert (null.size, null.text_crc32) == (1, 0)
    twins = [r for r in got if r.doc_id == 5]
    assert twins[0].shard == twins[1].shard and twins[0].slot != twins[1].slot and twins[0].text_crc32 == zlib.crc32("Überall ist die Straße naß".encode())
    assert S.shard_documents(empty).count() == 0 and S.shard_documents(clashing).count() == 3


def test_plan_has_no_python(spark, sf):
    from gristmill.llm.queries import QUERIES

    plan = QUERIES["op4_hash_tree_shards"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
