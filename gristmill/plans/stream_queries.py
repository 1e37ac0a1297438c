"""Queries over deadlines, spend gates and merged tables: the batch forms of what runs as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.operators import accounts
from gristmill.plans import stand_ins as S
from gristmill.runtime import checkpoint_dir, table
from gristmill.sources import sinks
from gristmill.streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)

DEADLINE, GRACE, NOW = 600, 600, "2024-01-29 12:00:00"
MONTH_CAP, DAY_CAP = 2_000_000, 120_000


def run_events(spark, sf_dir):
    """Each event as a run that starts then, and settles up to 25 minutes later, or never."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("millisecond", "ts").cast("timestamp"))
    started = e.select(F.col("event_id").alias("run_id"), "ts", F.lit("started").alias("state"))
    settled = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("run_id"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 37 % 1500)).alias("ts"), F.lit("settled").alias("state"))
    return started.unionByName(settled)


@query(f"""WITH e AS (SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events), r AS (SELECT event_id AS run_id, ts AS start, CASE WHEN event_id % 5 <> 0 THEN ts + to_seconds(event_id * 37 % 1500) END AS settled, ts + INTERVAL {DEADLINE} SECOND AS due, ts + INTERVAL {DEADLINE + GRACE} SECOND AS last FROM e),
o AS (SELECT run_id, 'settled' AS outcome, settled AS at_time FROM r WHERE settled < due UNION ALL SELECT run_id, 'timed_out', due FROM r WHERE settled IS NULL OR settled >= due
 UNION ALL SELECT run_id, 'released', settled FROM r WHERE settled >= due AND settled < last UNION ALL SELECT run_id, 'leaked', last FROM r WHERE settled IS NULL OR settled >= last)
SELECT run_id, outcome, epoch_ms(at_time) AS at_ms FROM o WHERE at_time <= TIMESTAMP '{NOW}'""")
def deadline_outcomes(spark, sf_dir):
    """What becomes of each run at its deadline and after its grace, up to a point in time."""
    found = accounts.deadline_outcomes(run_events(spark, sf_dir), F.lit(NOW).cast("timestamp"), DEADLINE, GRACE)
    return found.select("run_id", "outcome", F.unix_millis("at").alias("at_ms"))


def priced_calls(spark, sf_dir):
    """Each event as a priced call of its user; every eleventh cost is not recorded."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("org_id"), "ts", i.alias("seq"), F.floor(i / 7).alias("scan_id"), (i * 7919 % 100_000).alias("cost"), (i % 11 != 0).alias("recorded"))


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS org_id, event_id AS seq, event_id // 7 AS scan_id, event_id * 7919 % 100000 AS cost, event_id % 11 <> 0 AS recorded, strftime(ts, '%Y-%m') AS m, strftime(ts, '%Y-%m-%d') AS d,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
g(org_id, rn, seq, m, ms, d, ds, stopped, decision) AS (SELECT DISTINCT org_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST([] AS BIGINT[]), '' FROM o
 UNION ALL SELECT org_id, rn, seq, m, ms + CASE WHEN decision = 'allowed' AND recorded THEN cost ELSE 0 END, d, ds + CASE WHEN decision = 'allowed' AND recorded THEN cost ELSE 0 END,
   CASE WHEN decision = 'allowed' AND NOT recorded AND cost > 0 THEN list_append(stopped, scan_id) ELSE stopped END, decision
  FROM (SELECT *, CASE WHEN ms >= {MONTH_CAP} THEN 'monthly_exceeded' WHEN ds >= {DAY_CAP} THEN 'daily_exceeded' WHEN list_contains(stopped, scan_id) THEN 'unrecorded' ELSE 'allowed' END AS decision
   FROM (SELECT o.org_id, o.rn, o.seq, o.scan_id, o.cost, o.recorded, o.m, o.d, CASE WHEN g.m = o.m THEN g.ms ELSE 0 END AS ms, CASE WHEN g.d = o.d THEN g.ds ELSE 0 END AS ds, CASE WHEN g.m = o.m THEN g.stopped ELSE [] END AS stopped
    FROM g JOIN o ON o.org_id = g.org_id AND o.rn = g.rn + 1)))
SELECT org_id, seq, decision, ms AS month_spent FROM g WHERE rn > 0""")
def spend_decisions(spark, sf_dir):
    """Whether each call is within its org's budget when it comes, and what the month has spent after it."""
    return events.spend_gate(priced_calls(spark, sf_dir), MONTH_CAP, DAY_CAP)


def scan_rows(spark, sf_dir, where: str, version: int, status: str):
    return table(spark, sf_dir, "orders").where(where).select(F.col("o_orderkey").alias("run_id"), F.lit(version).alias("version"), F.lit(status).alias("status"), F.col("o_custkey").alias("org_id"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS version,
 CASE WHEN o_orderkey % 3 = 0 THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'pending' END AS status, o_custkey AS org_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""")
def merged_runs(spark, sf_dir):
    """Scan runs after four merges: running rows, later ones, the same later ones again, and stale ones that only add new keys."""
    path = f"{checkpoint_dir(spark)}/merged-{uuid.uuid4().hex}"
    later = scan_rows(spark, sf_dir, "o_orderkey % 3 = 0", 2, "completed")
    for rows in (scan_rows(spark, sf_dir, "o_orderkey % 2 = 0", 1, "running"), later, later, scan_rows(spark, sf_dir, "o_orderkey % 5 = 0", 0, "pending")):
        sinks.merge(rows, path, ["run_id"], ["version"], parts=16)
    return sinks.merged_rows(spark, path)
