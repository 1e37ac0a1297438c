"""Registered queries use every row of their tables."""

from gristmill import registry


def test_window_scoring_tests_each_side_against_its_own_hunks(spark, tmp_path):
    lines = [(1, 2, 1, 13), (2, 1, 2, 26 + 45), (3, 2, 3, 39), (3, 1, 3, 39 + 45)]  # the parent, the fix, both
    spark.createDataFrame([(s, n, p, o, 8, "R") for s, n, p, o in lines], "l_suppkey long, l_linenumber int, l_partkey long, l_orderkey long, l_quantity int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 5)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["window_scoring"](spark, str(tmp_path)).orderBy("case").collect()
    assert [tuple(r) for r in got] == [(1, True, True), (2, False, False), (3, True, False), (4, False, False)]


def test_insert_or_ignore_resolves_conflicts_on_both_sides(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (3, 4, 5, 6, 8, 7, 12, 13)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["insert_or_ignore"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(2, 6), (4, 12)]  # 3 and 4 share a key with the stored 5
