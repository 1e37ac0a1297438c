"""Deadlines, spend gates and merges: streams against their batch forms and plain loops, row by row."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gristmill.operators import accounts
from gristmill.plans import stream_queries as Q
from gristmill.runtime import table
from gristmill.sources import sinks
from gristmill.streaming import events as E

START = dt.datetime(2024, 1, 30, 23, 0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_a_deadline_is_passed_at_its_minute(spark):
    rows = [(1, 0, "started"), (1, 9, "settled"), (2, 0, "started"), (2, 10, "settled"), (3, 0, "started"), (3, 20, "settled"), (4, 5, "started"), (5, 3, "settled"), (5, 4, "started"), (5, 6, "settled"), (5, 7, "settled"), (6, 1, "settled"), (7, 55, "started")]
    df = spark.createDataFrame([(i, at(m), s) for i, m, s in rows], "run_id long, ts timestamp, state string")
    got = sorted((r.run_id, r.outcome, r["at"]) for r in accounts.deadline_outcomes(df, F.lit(at(60)), 600, 600).collect())
    assert got == [(1, "settled", at(9)), (2, "released", at(10)), (2, "timed_out", at(10)), (3, "leaked", at(20)), (3, "timed_out", at(10)), (4, "leaked", at(25)), (4, "timed_out", at(15)), (5, "settled", at(6))]


def test_deadline_stream_equals_batch(spark, sf, tmp_path):
    rows = Q.run_events(spark, sf)
    last = rows.agg(F.max("ts")).first()[0]
    later = spark.createDataFrame([(-1, last + dt.timedelta(hours=2), "settled"), (-2, last + dt.timedelta(hours=3), "settled")], "run_id long, ts timestamp, state string")  # the watermark passes every timer
    for i, part in enumerate([rows.where(f"ntile = {k}").drop("ntile") for rows in [rows.selectExpr("*", "ntile(4) OVER (ORDER BY ts) AS ntile")] for k in range(1, 5)] + [later.where("run_id = -1"), later.where("run_id = -2")]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = sorted((tmp_path / "in").glob("*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        f.rename(flat / f"{i}.parquet")
    stream = E.deadline_stream(E.event_stream(spark, str(flat), "run_id long, ts timestamp, state string"), Q.DEADLINE, Q.GRACE)
    got = E.drain(stream, "deadlines", str(tmp_path / "state"))
    want = accounts.deadline_outcomes(rows, F.lit(last + dt.timedelta(hours=2)), Q.DEADLINE, Q.GRACE)
    key = lambda df: sorted((r.run_id, r.outcome, r["at"]) for r in df.collect())
    assert key(got) == key(want) and got.count() > 200


def plain_gate(rows, month_cap, day_cap):
    spent, stopped, out = {}, set(), []
    for org, ts, seq, scan, cost, recorded in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        month, day = (org, ts.year, ts.month), (org, ts.date())
        if spent.get(month, 0) >= month_cap:
            out.append((org, seq, "monthly_exceeded", spent.get(month, 0)))
        elif spent.get(day, 0) >= day_cap:
            out.append((org, seq, "daily_exceeded", spent.get(month, 0)))
        elif (month, scan) in stopped:
            out.append((org, seq, "unrecorded", spent.get(month, 0)))
        else:
            if recorded:
                spent[month], spent[day] = spent.get(month, 0) + cost, spent.get(day, 0) + cost
            elif cost > 0:
                stopped.add((month, scan))
            out.append((org, seq, "allowed", spent.get(month, 0)))
    return sorted(out)


def test_spend_gate_stream_with_a_restart_equals_batch_and_loop(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(4), at(i * 37), i, r.randrange(i // 9 + 1), r.choice([0, 5, 20, 90]), r.random() > 0.15) for i in range(600)]  # past the end of a month
    schema = "org_id long, ts timestamp, seq long, scan_id long, cost long, recorded boolean"
    df = spark.createDataFrame(rows, schema)
    want = plain_gate(rows, 900, 300)
    assert {x[2] for x in want} == {"allowed", "monthly_exceeded", "daily_exceeded", "unrecorded"}
    key = lambda df: sorted((x.org_id, x.seq, x.decision, x.month_spent) for x in df.collect())
    assert key(E.spend_gate(df, 900, 300)) == want
    got = []
    for half in range(2):  # the second run goes on from the first one's state
        df.where((F.col("seq") >= 300 * half) & (F.col("seq") < 300 * (half + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = E.spend_gate_stream(E.event_stream(spark, f"{tmp_path}/in", schema, 100), 900, 300)
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((x.org_id, x.seq, x.decision, x.month_spent) for x in got) == want


def test_merges(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "id long, v long, what string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda p=path: sorted(map(tuple, sinks.merged_rows(spark, p).collect()), key=repr)
    assert sinks.merge(frame([]), path, ["id"], ["v"]) == 0
    sinks.merge(frame([(i, 1, "a") for i in range(100)] + [(5, 3, "late"), (None, 1, "none")]), path, ["id"], ["v"])
    first = read()
    assert len(first) == 101 and (5, 3, "late") in first and (None, 1, "none") in first
    update = frame([(5, 2, "stale"), (6, 2, "new"), (7, 1, "same version"), (200, 1, "added"), (200, 2, "added twice")])
    assert sinks.merge(update, path, ["id"], ["v"]) <= 4
    once = read()
    assert {x for x in once if x not in first} == {(6, 2, "new"), (200, 2, "added twice")} and len(once) == 102
    sinks.merge(update, path, ["id"], ["v"])
    assert read() == once  # a replayed batch changes nothing
    sinks.merge(frame([(6, 0, "ignored"), (300, 2, "b"), (300, 1, "a")]), path, ["id"], ["v"], first=True)
    assert [x for x in read() if x not in once] == [(300, 1, "a")] and len(read()) == 103


def test_merge_stream_survives_a_batch_that_runs_twice(spark, sf, tmp_path):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("v"))
    for i in range(3):
        orders.where(f"o_orderkey % 4 IN ({i}, {i + 1})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # another checkpoint: every batch comes again
        stream = E.event_stream(spark, f"{tmp_path}/in", "o_orderkey long, o_custkey long, v long")
        sinks.merge_stream(stream, f"{tmp_path}/out", ["o_orderkey"], ["v"], f"{tmp_path}/c{_}").awaitTermination()
        got = sinks.merged_rows(spark, f"{tmp_path}/out")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, orders.collect()))
