"""Queries over scan history, spend, events and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import experiments, findings, history
from gristmill.plans import stand_ins as S
from gristmill.runtime import table
from gristmill.streaming import events as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)


@query(f"""WITH {S.RUNS_SQL}, b AS (SELECT date_trunc('week', max(started_at)) AS last FROM runs), r AS (SELECT *, CAST(installation % 4 AS BIGINT) AS org FROM runs),
g AS (SELECT org, unnest(generate_series(last::TIMESTAMP - INTERVAL 77 DAY, last::TIMESTAMP, INTERVAL 7 DAY)) AS week FROM (SELECT DISTINCT org FROM r), b),
n AS (SELECT org, date_trunc('week', started_at) AS week, count(*) AS scans, sum(findings) AS findings FROM r GROUP BY ALL)
SELECT g.org, CAST(g.week AS DATE) AS week, coalesce(scans, 0) AS scans, CAST(coalesce(findings, 0) AS BIGINT) AS findings FROM g LEFT JOIN n ON g.org = n.org AND g.week = n.week""")
def weekly_trend_gapfilled(spark, sf_dir):
    r = S.runs(spark, sf_dir).withColumn("org", F.col("installation") % 4)
    last = r.agg(F.max("started_at").alias("t")).first()["t"]
    return history.weekly(r, ["org"], F.lit(last)).select("org", F.col("week").cast("date").alias("week"), "scans", "findings")


@query(f"WITH {S.RUNS_SQL} SELECT run_id, repo, status, started_at FROM runs ORDER BY started_at DESC, run_id LIMIT 100")
def newest_scans(spark, sf_dir):
    return history.newest(S.runs(spark, sf_dir)).select("run_id", "repo", "status", "started_at")


@query(f"WITH {S.RUNS_SQL} SELECT run_id, status, started_at FROM runs WHERE finished_at IS NULL AND started_at < TIMESTAMP '1998-01-01' ORDER BY started_at, run_id LIMIT 20")
def oldest_unfinished(spark, sf_dir):
    return history.oldest_unfinished(S.runs(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("run_id", "status", "started_at")


@query(f"WITH {S.RUNS_SQL} SELECT run_id, repo FROM runs WHERE installation = (SELECT min(installation) FROM runs) AND repo IN ('repo1', 'repo2', 'repo5')")
def visible_scans(spark, sf_dir):
    r = S.runs(spark, sf_dir)
    first = r.agg(F.min("installation").alias("i")).first()["i"]
    return history.visible(r, first, ["repo1", "repo2", "repo5"]).select("run_id", "repo")


@query(f"WITH {S.RUNS_SQL} SELECT run_id, repo FROM runs WHERE installation = 7 AND list_contains([]::VARCHAR[], repo)")
def visible_scans_none(spark, sf_dir):
    return history.visible(S.runs(spark, sf_dir), 7, []).select("run_id", "repo")


@query(f"""WITH {S.RUNS_SQL}, asked AS (SELECT o_orderkey AS ask, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS installation, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS run_id FROM orders)
SELECT ask, a.run_id, r.installation, r.repo, r.status FROM asked a JOIN runs r ON r.run_id = a.run_id AND r.installation = a.installation AND CAST(substr(r.repo, 5) AS INTEGER) IN (a.installation % 7, (a.installation + 2) % 7, (a.installation + 3) % 7)""")
def scan_point_lookup(spark, sf_dir):
    """Every order asks for a run: own ones, those of the next tenant, missing ones; three repositories are granted to each tenant."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("ask"), F.when(k % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("installation"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("run_id"))
    i = F.col("installation")
    grants = asked.select("installation").distinct().select(i, F.explode(F.array(i % 7, (i + 2) % 7, (i + 3) % 7)).alias("n")).select("installation", F.concat(F.lit("repo"), F.col("n").cast("string")).alias("repo"))
    return history.lookup(asked, S.runs(spark, sf_dir), grants).select("ask", "run_id", "installation", "repo", "status")


@query(f"""WITH {S.LEDGER_SQL} SELECT c_custkey AS org_id, CAST(coalesce(sum(cost_usd) FILTER (WHERE recorded_at >= TIMESTAMP '1996-01-01'), 0) AS BIGINT) AS recent, CAST(coalesce(sum(cost_usd), 0) AS BIGINT) AS total, count(entry) AS rows FROM customer LEFT JOIN ledger ON org_id = c_custkey GROUP BY 1""")
def org_spend_summary(spark, sf_dir):
    orgs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"))
    return history.org_summary(orgs, S.ledger(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"))


@query("""WITH ids AS (SELECT unnest([5, 999999999, 3, 1]) AS org_id, unnest([0, 1, 2, 3]) AS ord), o AS (SELECT c_custkey AS org_id, c_mktsegment AS plan, c_acctbal AS cap_usd, c_acctbal * 2 AS spent_usd FROM customer)
SELECT ord, ids.org_id, coalesce(plan, 'free') AS plan, coalesce(cap_usd, 5.0) AS cap_usd, coalesce(spent_usd, 0.0) AS spent_usd FROM ids LEFT JOIN o USING (org_id)""")
def ordered_org_lookup(spark, sf_dir):
    ids = S.inline(spark, "org_id int, ord int", [(5, 0), (999999999, 1), (3, 2), (1, 3)])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.col("c_mktsegment").alias("plan"), F.col("c_acctbal").alias("cap_usd"), (F.col("c_acctbal") * 2).alias("spent_usd"))
    return history.ordered_lookup(ids, c)


@query(f"""WITH {S.LEDGER_SQL} SELECT org_id, CAST(coalesce(sum(cost_usd) FILTER (WHERE recorded_at >= TIMESTAMP '1997-06-01' AND recorded_at <= TIMESTAMP '1997-06-17 12:00:00'), 0) AS BIGINT) AS month_usd,
CAST(coalesce(sum(cost_usd) FILTER (WHERE recorded_at >= TIMESTAMP '1997-06-17' AND recorded_at <= TIMESTAMP '1997-06-17 12:00:00'), 0) AS BIGINT) AS day_usd FROM ledger GROUP BY org_id""")
def month_day_to_date_spend(spark, sf_dir):
    return history.spend_since(S.ledger(spark, sf_dir), ["org_id"], F.lit("1997-06-17 12:00:00").cast("timestamp"))


@query(f"""WITH {S.LEDGER_SQL}, m AS (SELECT org_id, date_trunc('month', recorded_at) AS month, sum(cost_usd) AS spent FROM ledger GROUP BY ALL), b AS (SELECT *, spent / 30000000.0 AS ratio FROM m)
SELECT org_id, CAST(month AS DATE) AS month, CAST(spent AS BIGINT) AS spent, CASE WHEN ratio >= 1 THEN 'exceeded' WHEN ratio >= 0.8 THEN 'warning' ELSE 'ok' END AS state FROM b""")
def budget_state(spark, sf_dir):
    m = S.ledger(spark, sf_dir).groupBy("org_id", F.date_trunc("month", "recorded_at").cast("date").alias("month")).agg(F.sum("cost_usd").alias("spent"))
    return m.withColumn("state", history.budget_state(F.col("spent"), F.lit(30000000.0)))


@query(f"WITH {S.LEDGER_SQL} SELECT entry, org_id, CAST(sum(cost_usd) OVER (PARTITION BY org_id, date_trunc('month', recorded_at) ORDER BY recorded_at, entry ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_usd FROM ledger")
def running_month_spend(spark, sf_dir):
    return history.running_spend(S.ledger(spark, sf_dir), ["org_id"], "entry").select("entry", "org_id", "running_usd")


@query(f"""WITH {S.values('p', 'model, i, o', S.PRICES)}, c AS (SELECT l_orderkey, l_linenumber, ['large', 'medium', 'small', 'unknown'][l_linenumber % 4 + 1] AS model, l_quantity AS a, l_partkey AS b, l_suppkey AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, c.model, round(coalesce(((a + w * 1.25 + b * 0.1) * i::DOUBLE + b * o::DOUBLE) / 1000000, 0), 9) AS cost_usd FROM c LEFT JOIN p USING (model)""")
def call_cost(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ["large", "medium", "small", "unknown"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", model.alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_partkey").alias("output_tokens"), F.col("l_suppkey").alias("cache_write_tokens"), F.col("l_partkey").alias("cache_read_tokens"))
    prices = S.inline(spark, "model string, input_usd double, output_usd double", S.PRICES)
    return history.call_cost(calls, prices).select("l_orderkey", "l_linenumber", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query("""SELECT n AS files, n // 3 AS route_files, round((n // 3) * 3 * 0.012, 6) AS expected, round((n // 3) * 3 * 0.012 + n * 3 * 0.012, 6) AS worst, round(n * (1.5 + 6 * 3.8), 3) AS seconds FROM (SELECT count(*) AS n FROM documents)""")
def scan_cost_estimate(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("files"))
    n = n.withColumn("route_files", F.floor(F.col("files") / 3))
    usd, worst, s = history.scan_estimate(F.col("files"), F.col("route_files"))
    return n.select("files", "route_files", F.round(usd, 6).alias("expected"), F.round(worst, 6).alias("worst"), F.round(s, 3).alias("seconds"))


@query(f"WITH {S.RUNS_SQL} SELECT run_id, EXISTS (SELECT 1 FROM runs n WHERE n.installation = r.installation AND n.repo = r.repo AND n.pull = r.pull AND n.started_at > r.started_at) AS superseded FROM runs r")
def newer_run_exists(spark, sf_dir):
    return history.newer_run(S.runs(spark, sf_dir), ["installation", "repo", "pull"]).select("run_id", "superseded")


SWEEP = """WITH {runs}, n AS (SELECT installation, repo, pull, max(started_at) AS latest FROM runs GROUP BY ALL)
SELECT run_id, CASE WHEN latest > started_at THEN 'superseded' WHEN status = 'retrying' THEN 'abandoned' ELSE 'retry' END AS decision
FROM runs JOIN n USING (installation, repo, pull) WHERE finished_at IS NULL AND status <> 'completed' AND started_at < TIMESTAMP '1998-08-01' - INTERVAL 10 MINUTE {limit}"""


@query(SWEEP.format(runs=S.RUNS_SQL, limit="ORDER BY started_at, run_id LIMIT 20"))
def sweep_decision(spark, sf_dir):
    return history.sweep(S.runs(spark, sf_dir), F.lit("1998-08-01").cast("timestamp"), ["installation", "repo", "pull"]).select("run_id", "decision")


@query(SWEEP.format(runs=S.RUNS_SQL, limit=""))
def sweep_decision_all(spark, sf_dir):
    return history.sweep(S.runs(spark, sf_dir), F.lit("1998-08-01").cast("timestamp"), ["installation", "repo", "pull"], None).select("run_id", "decision")


@query("""WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'retrying' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'completed' ELSE 'running' END ELSE CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'pending' END END AS state FROM events),
g AS (SELECT run_id, count(*) AS events, arg_min(state, seq) FILTER (state IN ('completed', 'failed')) AS final, count(*) FILTER (state = 'retrying') AS r, count(*) FILTER (state = 'running') AS n FROM e GROUP BY run_id)
SELECT run_id, coalesce(final, CASE WHEN r > 0 THEN 'retrying' WHEN n > 0 THEN 'running' ELSE 'pending' END) AS state, events FROM g""")
def run_state_fold(spark, sf_dir):
    t, four = F.col("event_type"), F.col("event_id") % 4 == 0
    state = F.when(t == "signup", "pending").when(t == "click", "running").when(t == "view", "retrying").when(t == "purchase", F.when(four, "completed").otherwise("running")).otherwise(F.when(four, "failed").otherwise("pending"))
    return history.fold_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state")))


STATUSES = ["budget_exceeded", "failed", "success", "budget_unverifiable", "no_action", "spend_unrecordable", "partial_success"]


@query(f"""WITH e AS (SELECT event_id, [{', '.join(map(S.sql_literal, STATUSES))}][event_id % 7 + 1] AS status, event_id % 2 = 0 AS covered, event_id % 11 = 0 AS degraded, event_id % 3 AS calls, event_id % 5 AS det FROM events)
SELECT event_id, CASE WHEN status LIKE 'budget%' OR status LIKE 'spend%' THEN 'skipped' WHEN NOT covered AND status = 'failed' THEN 'failed' WHEN degraded OR calls > 1 OR det > 3 THEN 'incomplete' ELSE 'completed' END AS final,
CASE WHEN status LIKE 'budget%' OR status LIKE 'spend%' THEN status WHEN NOT covered AND status = 'failed' THEN 'scan_failed' WHEN degraded OR calls > 1 OR det > 3 THEN 'coverage_degraded' END AS code FROM e""")
def outcome_mapping(spark, sf_dir):
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (e % 7 + 1).cast("int"))
    final, code = history.outcome(status, e % 2 == 0, e % 11 == 0, e % 3 - 1, e % 5 - 3)
    return table(spark, sf_dir, "events").select("event_id", final.alias("final"), code.alias("code"))


@query("""WITH d AS (SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN 'dl-' || (user_id % 40) END AS delivery_id FROM events)
SELECT delivery_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY ts, event_id) AS r FROM d) WHERE r = 1 OR delivery_id IS NULL""")
def delivery_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("dl-"), (F.col("user_id") % 40).cast("string"))).alias("delivery_id"), "event_id", "ts")
    return history.first_deliveries(d, order=["ts", "event_id"])


@query(f"""WITH {S.dealt_sql('p', 'payload', S.PAYLOADS)}, a AS (SELECT doc_id, payload, payload->>'$.action' AS action, json_type(payload, '$.changes.base') = 'OBJECT' AS base FROM p),
s AS (SELECT *, coalesce(action IN ('opened', 'synchronize', 'reopened') OR (action = 'edited' AND coalesce(base, false)), false) AS scan FROM a)
SELECT doc_id, payload, scan, CASE WHEN scan THEN NULL WHEN action IS NULL THEN 'action_missing' WHEN action = 'edited' THEN 'edited_without_base_change' WHEN action IN ({', '.join(map(S.sql_literal, history.NON_CODE_ACTIONS))}) THEN 'action_not_scanned' ELSE 'action_unrecognized' END AS reason FROM s""")
def action_filter(spark, sf_dir):
    scan, reason = history.action_decision(F.col("payload"))
    return S.dealt(spark, sf_dir, "payload string", S.PAYLOADS).select("doc_id", "payload", scan.alias("scan"), reason.alias("reason"))


@query("""SELECT c_nationkey AS inst, min(CAST(c_custkey AS BIGINT)) AS first_seen, max(CAST(c_custkey AS BIGINT)) AS last_seen FROM customer GROUP BY 1""")
def installation_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("inst"), F.col("c_custkey").alias("seen"))
    return history.upsert_latest(c.where("seen % 2 = 0"), c.where("seen % 2 = 1"), "inst", "seen")


@query("""WITH e AS (SELECT event_id, event_id // 3 AS k FROM events) SELECT k, min(event_id) AS event_id FROM e WHERE event_id % 5 <> 0 AND k NOT IN (SELECT k FROM e WHERE event_id % 5 = 0) GROUP BY k""")
def insert_or_ignore(spark, sf_dir):
    """Every event is on one side: each fifth is stored, the others come in, three to a key; the first of a key goes in."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("k"), "event_id")
    return history.insert_new(e.where("event_id % 5 = 0"), e.where("event_id % 5 <> 0"), "k", ["event_id"])


@query("""SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 50 GROUP BY ALL""")
def claim_once_per_month(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 50")
    return history.once_per_month(e, ["user_id"], "ts", "event_id").select("user_id", F.col("month").cast("date").alias("month"), "event_id")


@query("""WITH t AS (SELECT sha256('tok-' || c_custkey) AS h, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS revoked FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, sha256('tok-' || c_custkey) IN (SELECT h FROM t WHERE revoked IS NULL) AS accepted FROM customer""")
def token_verify(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tok = F.concat(F.lit("tok-"), F.col("c_custkey").cast("string"))
    stored = c.where("c_custkey % 2 = 0").select(F.sha2(tok, 256).alias("token_hash"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("revoked_at"))
    return history.verify_tokens(c.select("c_custkey", tok.alias("token")), stored).select("c_custkey", "accepted")


@query("SELECT * FROM (VALUES ('i1', TIMESTAMP '2024-01-02 12:00:00', 1.5), ('i2', TIMESTAMP '2024-03-04 12:00:00', 2.0)) t(installation, recorded_at, cost_usd)")
def nested_ledger_rows(spark, sf_dir):
    nested = S.inline(spark, "ledger map<string,map<string,string>>", [({"i1": {"2024-01-02": "1.5", "bad": "3", "2024-01-03": "-1"}, "i2": {"2024-03-04": "2", "2024-03-05": "x", "2024-03-06": "NaN"}},)])
    return history.ledger_rows(nested)


@query(f"WITH {S.JUDGED_SQL} SELECT bucket, count(*) AS runs, count(*) FILTER (asserted AND NOT flagged) AS not_emitted FROM bucketed GROUP BY bucket")
def verdict_census(spark, sf_dir):
    return experiments.census(S.judged_runs(spark, sf_dir))


@query(f"""WITH {S.JUDGED_SQL} SELECT fixture, count(*) FILTER (asserted) AS asserted_runs, count(*) AS total_runs, coalesce(string_agg(DISTINCT CASE WHEN asserted THEN bucket END, ',' ORDER BY CASE WHEN asserted THEN bucket END), '') AS classes, count(*) FILTER (asserted AND NOT flagged) AS not_emitted FROM bucketed WHERE NOT is_positive GROUP BY fixture HAVING count(*) FILTER (asserted) > 0""")
def masked_negatives(spark, sf_dir):
    return experiments.masked_negatives(S.judged_runs(spark, sf_dir))


@query(f"""WITH {S.JUDGED_SQL} SELECT fixture, count(*) FILTER (NOT asserted) AS clean, count(*) FILTER (asserted AND bucket = 'vulnerable-high' AND fixture % 2 = 0) AS excused, count(*) FILTER (asserted AND NOT (bucket = 'vulnerable-high' AND fixture % 2 = 0)) AS violations FROM bucketed WHERE NOT is_positive GROUP BY fixture""")
def negative_score(spark, sf_dir):
    r = S.judged_runs(spark, sf_dir)
    allowed = r.where("fixture % 2 = 0").select("fixture", F.lit("vulnerable-high").alias("bucket")).distinct()
    return experiments.negative_score(r, allowed)


@query(f"""WITH {S.JUDGED_SQL}, g AS (SELECT fixture, is_positive, count(*) AS n, count(*) FILTER (flagged) AS flagged_runs FROM judged GROUP BY ALL) SELECT *, CASE WHEN is_positive THEN flagged_runs >= greatest(n - 1, 1) ELSE flagged_runs = 0 END AS stable FROM g""")
def stability_k_of_n(spark, sf_dir):
    return experiments.stability(S.judged_runs(spark, sf_dir))


PAIR_SQL = """r AS (SELECT CAST(user_id % 2 AS BIGINT) AS "set", CAST(user_id % 25 AS BIGINT) AS "case", CAST(user_id AS BIGINT) AS path, CASE WHEN event_id % 2 = 0 THEN 'parent' ELSE 'fix' END AS side,
  CASE WHEN user_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_id % 3 = 0 END AS emitted, event_id % 97 <> 0 AS complete FROM events),
g AS (SELECT "set", "case", path, count(*) FILTER (side = 'parent') AS parent_runs, count(*) FILTER (side = 'fix') AS fix_runs, count(*) FILTER (side = 'parent' AND emitted) AS parent_emits, count(*) FILTER (side = 'fix' AND emitted) AS fix_emits, bool_and(complete) AS complete FROM r GROUP BY ALL),
h AS (SELECT *, complete AND parent_runs > 0 AND fix_runs > 0 AND parent_emits >= ceil(parent_runs * 4 / 5) AND fix_emits <= fix_runs - ceil(fix_runs * 4 / 5) AS hit FROM g)"""


def _pairs(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select((u % 2).alias("set"), (u % 25).alias("case"), u.alias("path"), F.when(e % 2 == 0, "parent").otherwise("fix").alias("side"), F.when(u % 3 == 0, e % 2 == 0).otherwise(e % 3 == 0).alias("emitted"), (e % 97 != 0).alias("complete"))
    return experiments.paired(rows)


@query(f"WITH {PAIR_SQL} SELECT * FROM h")
def paired_scoring(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"""WITH {PAIR_SQL}, c AS (SELECT "set", "case", max(hit) AS hit FROM h GROUP BY ALL), s AS (SELECT "set", count(*) AS cases, count(*) FILTER (hit) AS hits FROM c GROUP BY ALL)
SELECT *, CASE WHEN hits >= 4 THEN 'PASS' WHEN hits <= 1 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS label, false AS noisy FROM s""")
def paired_label(spark, sf_dir):
    return experiments.paired_label(_pairs(spark, sf_dir), F.lit(2))


#: Trial runs from events: ten to a case, five a state; some voided or of another state, so that cases are incomplete.
TRIALS_SQL = """r AS (SELECT event_id // 10 AS "case", CASE (event_id // 10) % 3 WHEN 0 THEN 'held-out' WHEN 1 THEN 'post-cutoff' ELSE 'clean' END AS "set",
  CASE WHEN event_id % 97 = 0 THEN 'other' WHEN event_id % 10 < 5 THEN 'vulnerable' ELSE 'fix' END AS state, CASE WHEN event_id % 10 < 5 THEN event_id % 7 <> 0 ELSE event_id % 11 = 0 END AS hit,
  event_id % 31 = 0 AS voided, event_id % 43 = 0 AS unreviewable FROM events),
k AS (SELECT DISTINCT "set", "case", "case" % 8 <> 0 AS accepted, "case" % 5 <> 1 AS has_fix FROM r),
g AS (SELECT "set", "case", count(*) FILTER (state = 'vulnerable') AS vulnerable_runs, count(*) FILTER (state = 'fix') AS fix_runs, count(*) FILTER (state = 'vulnerable' AND hit AND NOT voided) AS vulnerable_hits, count(*) FILTER (state = 'fix' AND hit AND NOT voided) AS fix_hits,
  count(*) FILTER (voided AND state <> 'other') AS voided, count(*) FILTER (unreviewable AND state <> 'other') AS unreviewable FROM r GROUP BY ALL),
c AS (SELECT k.*, vulnerable_runs, fix_runs, vulnerable_hits, fix_hits, voided, unreviewable, vulnerable_runs = 5 AND (NOT has_fix OR fix_runs = 5) AS complete,
  accepted AND vulnerable_runs = 5 AND fix_runs = 5 AND has_fix AND vulnerable_hits >= 4 AND fix_hits <= 1 AS hit FROM k JOIN g USING ("set", "case"))"""


def _trials(spark, sf_dir):
    e, case = F.col("event_id"), F.floor(F.col("event_id") / 10)
    early = e % 10 < 5
    name = F.when(case % 3 == 0, "held-out").when(case % 3 == 1, "post-cutoff").otherwise("clean")
    return table(spark, sf_dir, "events").select(case.alias("case"), name.alias("set"), F.when(e % 97 == 0, "other").when(early, "vulnerable").otherwise("fix").alias("state"), F.when(early, e % 7 != 0).otherwise(e % 11 == 0).alias("hit"), (e % 31 == 0).alias("voided"), (e % 43 == 0).alias("unreviewable"), e.alias("event_id"))


def _cases(spark, sf_dir):
    runs = _trials(spark, sf_dir)
    planned = runs.select("set", "case").distinct().withColumn("accepted", F.col("case") % 8 != 0).withColumn("has_fix", F.col("case") % 5 != 1)
    return experiments.case_scores(planned, runs)


@query(f"WITH {TRIALS_SQL} SELECT * FROM c")
def case_scoring(spark, sf_dir):
    return _cases(spark, sf_dir)


CLEAN_SQL = """w AS (SELECT event_id, event_id // 5 + CASE WHEN event_id % 55 = 0 THEN 1 ELSE 0 END AS "case" FROM events),
cl AS (SELECT "case", count(*) AS runs, count(*) FILTER (event_id % 4 <> 0 AND event_id % 29 <> 0) AS flagged_runs, count(*) FILTER (event_id % 43 = 0) AS unreviewable, count(*) = 5 AND count(*) FILTER (event_id % 4 <> 0 AND event_id % 29 <> 0) >= 4 AS flagged FROM w GROUP BY ALL)"""


def _clean(spark, sf_dir):
    """Clean changes, five events each as their runs; some runs count for the next change, which then has six."""
    e = F.col("event_id")
    case = F.floor(e / 5) + F.when(e % 55 == 0, 1).otherwise(0)
    rows = table(spark, sf_dir, "events").select(case.alias("case"), (e % 4 != 0).alias("any_finding"), (e % 29 == 0).alias("voided"), (e % 43 == 0).alias("unreviewable"))
    return experiments.clean_scores(rows.select("case").distinct(), rows)


@query(f"WITH {CLEAN_SQL} SELECT * FROM cl")
def clean_scoring(spark, sf_dir):
    return _clean(spark, sf_dir)


@query(f"""WITH {TRIALS_SQL}, {CLEAN_SQL}, h AS (SELECT ("case" // 3) % 25 AS series, count(*) FILTER (accepted) AS accepted, count(*) FILTER (hit) AS hits, bool_and(complete) FILTER (accepted) AS complete, sum(voided) > 4 AS void FROM c WHERE "set" = 'held-out' GROUP BY ALL),
q AS (SELECT "case" % 25 AS series, count(*) AS planned, count(*) FILTER (flagged) AS flags FROM cl GROUP BY ALL)
SELECT series, accepted, hits, flags, planned, CASE WHEN accepted < 8 THEN 'AGENTIC-PRECONDITION-FAILED' WHEN void THEN 'AGENTIC-STOP' WHEN NOT complete THEN 'AGENTIC-INCOMPLETE' WHEN hits >= 4 AND flags <= floor(planned * 3 / 10) THEN 'AGENTIC-CONTINUE' ELSE 'AGENTIC-STOP' END AS label FROM h JOIN q USING (series)""")
def gate_label(spark, sf_dir):
    held = _cases(spark, sf_dir).where(F.col("set") == "held-out")
    h = held.groupBy((F.floor(F.col("case") / 3) % 25).alias("series")).agg(F.count_if("accepted").alias("accepted"), F.count_if("hit").alias("hits"), F.bool_and(F.when(F.col("accepted"), F.col("complete"))).alias("complete"), (F.sum("voided") > 4).alias("void"))
    q = _clean(spark, sf_dir).groupBy((F.col("case") % 25).alias("series")).agg(F.count("*").alias("planned"), F.count_if("flagged").alias("flags"))
    label = experiments.gate_label(F.col("accepted"), F.col("hits"), F.col("flags"), F.col("planned"), F.col("void"), F.col("complete"))
    return h.join(q, "series").select("series", "accepted", "hits", "flags", "planned", label.alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'PROXY-INCOMPLETE' WHEN event_id % 4 + 2 <> 5 THEN 'PROXY-PRELIMINARY' WHEN event_id % 7 >= 4 THEN 'PROXY-PASS' WHEN event_id % 7 <= 1 THEN 'PROXY-FAIL' ELSE 'PROXY-INCONCLUSIVE' END AS label FROM events""")
def proxy_label(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", experiments.proxy_label(e % 9 != 0, e % 4 + 2, e % 7).alias("label"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 50 AS "case", CASE WHEN l_linenumber % 2 = 0 THEN 'parent' ELSE 'fix' END AS side, l_partkey % 10 AS path, l_orderkey % 4000 AS line, l_returnflag AS family FROM lineitem),
h AS (SELECT DISTINCT s_suppkey % 50 AS "case", s_suppkey % 10 AS path, x.side, CAST((s_suppkey * 13) % 3800 + x.shift AS BIGINT) AS f, 'R' AS family FROM supplier, (VALUES ('parent', 0), ('fix', 45)) x(side, shift)),
n AS (SELECT "case", bool_or(side = 'parent') AS p, bool_or(side = 'fix') AS x FROM f JOIN h USING ("case", side, path, family) WHERE line BETWEEN f - 20 AND f + 3 + 20 GROUP BY ALL)
SELECT DISTINCT h."case", coalesce(p, false) AS registered, coalesce(p, false) AND NOT coalesce(x, false) AS discriminating FROM h LEFT JOIN n USING ("case")""")
def window_scoring(spark, sf_dir):
    """All of lineitem as findings; the fix's hunks lie 45 lines below the parent's."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("case"), F.when(F.col("l_linenumber") % 2 == 0, "parent").otherwise("fix").alias("side"), (F.col("l_partkey") % 10).alias("path"), (F.col("l_orderkey") % 4000).alias("line"), F.col("l_returnflag").alias("family"))
    s = F.col("s_suppkey")
    sides = F.explode(F.array(F.struct(F.lit("parent").alias("side"), F.lit(0).alias("shift")), F.struct(F.lit("fix").alias("side"), F.lit(45).alias("shift"))))
    first = (s * 13) % 3800 + F.col("x.shift")
    hunks = table(spark, sf_dir, "supplier").withColumn("x", sides).select((s % 50).alias("case"), (s % 10).alias("path"), "x.side", first.alias("first"), (first + 3).alias("last"), F.lit("R").alias("family")).distinct()
    return experiments.window_scores(li, hunks)


@query("""SELECT coalesce(a.ord, b.ord) AS ord, a.v AS left_value, b.v AS right_value FROM (SELECT n_nationkey AS ord, n_name AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 4 = 0 THEN 'X' ELSE n_name END AS v FROM nation WHERE n_nationkey > 2) b USING (ord) WHERE a.v IS DISTINCT FROM b.v""")
def list_drift(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("value"))
    return experiments.drift(n.where("ord < 20"), n.where("ord > 2").withColumn("value", F.when(F.col("ord") % 4 == 0, "X").otherwise(F.col("value"))))


@query("""SELECT user_id, event_id, ts, event_type, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 3""")
def newest_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return findings.newest_per(e, ["user_id"], [F.desc("ts"), "event_id"], 3)


@query()
def fixed_window_limiter(spark, sf_dir):
    return streams.limit_rate(table(spark, sf_dir, "events"), most=2, seconds=3600)
