"""Queries over tenants, call ledgers, study corpora and recorded sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import accounts, corpora, history
from gristmill.plans import stand_ins as S
from gristmill.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)
Q = S.sql_literal


@query("""WITH e AS (SELECT user_id AS installation, event_id AS seq, event_type AS source_event FROM events), o AS (SELECT DISTINCT user_id AS installation FROM events WHERE user_id % 4 = 0)
SELECT installation, max(seq) AS last_seen, installation NOT IN (SELECT * FROM o) AS created, CASE WHEN installation NOT IN (SELECT * FROM o) THEN 'free' END AS plan, CASE WHEN installation NOT IN (SELECT * FROM o) THEN 5.0 END AS cap_usd,
CASE WHEN installation NOT IN (SELECT * FROM o) THEN arg_min(source_event, seq) END AS source_event FROM e GROUP BY installation""")
def provisioned_orgs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("installation"), F.col("event_id").alias("seq"), F.col("event_type").alias("source_event"))
    return accounts.provisioned(rows, rows.where("installation % 4 = 0").select("installation"))


TIERS = [("solo", 10.0), ("team", 50.0), ("scale", 200.0)]


@query(f"""WITH {S.values('t', 'tier, cap', TIERS)}, e AS (SELECT user_id AS org, event_id AS seq, CASE event_type WHEN 'signup' THEN 'subscription.updated' WHEN 'purchase' THEN 'transaction.completed' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'subscription.canceled' ELSE 'transaction.payment_failed' END ELSE 'other' END AS event,
 ['solo', 'team', 'scale'][event_id % 3 + 1] AS tier, 'c' || (event_id % 5) AS customer, 's' || event_id AS subscription FROM events),
k AS (SELECT e.*, cap, event IN ('subscription.canceled', 'transaction.payment_failed') AS down FROM e LEFT JOIN t USING (tier) WHERE event <> 'other'),
l AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY seq DESC) AS r FROM k)
SELECT l.org, CASE WHEN down THEN 'free' ELSE tier END AS plan, CASE WHEN down THEN 5.0 ELSE cap END AS cap_usd, CASE WHEN NOT down THEN subscription END AS subscription, p.customer, p.audit_rows
FROM l JOIN (SELECT org, arg_max(customer, seq) FILTER (event = 'transaction.completed') AS customer, count(*) AS audit_rows FROM k GROUP BY org) p USING (org) WHERE r = 1""")
def plan_changes(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    name = F.when(t == "signup", accounts.CHANGED).when(t == "purchase", accounts.PAID).when(t == "view", F.when(i % 2 == 0, accounts.DOWNGRADES[0]).otherwise(accounts.DOWNGRADES[1])).otherwise("other")
    tier = F.element_at(F.array(*(F.lit(x) for x, _ in TIERS)), (i % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("org"), i.alias("seq"), name.alias("event"), tier.alias("tier"), F.concat(F.lit("c"), (i % 5).cast("string")).alias("customer"), F.concat(F.lit("s"), i.cast("string")).alias("subscription"))
    return accounts.plan_state(rows, S.inline(spark, "tier string, cap_usd double", TIERS))


@query("""WITH s AS (SELECT c_custkey AS tenant, ['low', 'medium', 'high'][c_nationkey % 3 + 1] AS severity, [c_mktsegment, c_mktsegment || '/**'] AS globs, CASE WHEN c_custkey % 4 <> 0 THEN ['idor'] END AS enabled, CASE WHEN c_custkey % 5 <> 0 THEN 'https://h/' || c_custkey END AS hook FROM customer),
n AS (SELECT tenant, CASE WHEN tenant % 6 = 0 THEN 'critical' ELSE severity END AS severity, CASE WHEN tenant % 7 = 0 THEN [globs[2], globs[1]] ELSE globs END AS globs, CASE WHEN tenant % 9 = 0 THEN ['idor', 'env-exposure'] WHEN tenant % 8 = 0 THEN []::VARCHAR[] ELSE enabled END AS enabled, CASE WHEN tenant % 10 = 0 THEN 'https://new' ELSE hook END AS hook FROM s)
SELECT * FROM (SELECT tenant, concat_ws(',', CASE WHEN n.severity IS DISTINCT FROM s.severity THEN 'severityThreshold' END, CASE WHEN n.globs IS DISTINCT FROM s.globs THEN 'ignoredGlobs' END, CASE WHEN n.enabled IS DISTINCT FROM s.enabled THEN 'enabledDetectors' END, CASE WHEN n.hook IS DISTINCT FROM s.hook THEN 'slackWebhookUrl' END) AS fields FROM s JOIN n USING (tenant)) WHERE fields <> ''""")
def settings_audit(spark, sf_dir):
    t = F.col("tenant")
    old = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tenant"), F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("severity"), F.array("c_mktsegment", F.concat("c_mktsegment", F.lit("/**"))).alias("globs"),
        F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit("idor"))).alias("enabled"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string"))).alias("hook"),
    )
    enabled = F.when(t % 9 == 0, F.array(F.lit("idor"), F.lit("env-exposure"))).when(t % 8 == 0, F.array().cast("array<string>")).otherwise(F.col("enabled"))
    new = old.select("tenant", F.when(t % 6 == 0, "critical").otherwise(F.col("severity")).alias("severity"), F.when(t % 7 == 0, F.reverse("globs")).otherwise(F.col("globs")).alias("globs"), enabled.alias("enabled"), F.when(t % 10 == 0, "https://new").otherwise(F.col("hook")).alias("hook"))
    return accounts.settings_changes(old, new)


@query("""WITH h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || url ELSE replace(url, 'http:', 'https:') END AS hook FROM pages) SELECT page_id, CASE WHEN hook IS NOT NULL AND hook <> '' AND NOT regexp_matches(trim(hook), '(?i)^https:/*[^\\s/?#]+') THEN 'slackWebhookUrl must be an https:// URL' END AS error FROM h""")
def hook_validation(spark, sf_dir):
    i = F.col("page_id") % 5
    hook = F.when(i == 0, F.lit(None)).when(i == 1, "").when(i == 2, F.concat(F.lit(" "), "url")).otherwise(F.replace("url", F.lit("http:"), F.lit("https:")))
    return table(spark, sf_dir, "pages").select("page_id", accounts.hook_error(hook).alias("error"))


@query("""WITH c AS (SELECT user_id % 50 AS caller, event_id AS seq, CASE WHEN event_id % 6 <> 0 OR user_id % 50 < 20 THEN event_id % 100 END AS cost FROM events)
SELECT caller, count(*) FILTER (seq > 300) AS calls, count(cost) FILTER (seq > 300) AS priced_calls, CAST(coalesce(sum(cost) FILTER (seq > 300), 0) AS BIGINT) AS cost_usd, count(*) FILTER (seq > 300) > 0 AND count(*) FILTER (seq > 300) = count(cost) FILTER (seq > 300) AS measured FROM c GROUP BY caller""")
def call_ledger_since(spark, sf_dir):
    """Calls, priced calls and cost after a snapshot."""
    i, u = F.col("event_id"), F.col("user_id") % 50
    calls = table(spark, sf_dir, "events").select(u.alias("caller"), i.alias("seq"), F.when((i % 6 != 0) | (u < 20), i % 100).alias("cost_usd"))
    return accounts.call_totals(calls, ["caller"], F.lit(300))


@query("""WITH c AS (SELECT user_id % 20 AS caller, event_id AS seq, event_id % 4 <> 0 AS ok, event_type AS reason FROM events WHERE event_id > 200) SELECT caller, reason, count(*) FILTER (NOT ok) AS failed, any_value(a.n) AS attempted FROM c JOIN (SELECT caller, count(*) AS n FROM c GROUP BY 1) a USING (caller) GROUP BY ALL HAVING count(*) FILTER (NOT ok) > 0""")
def failures_since_snapshot(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("caller"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 != 0).alias("ok"), F.col("event_type").alias("reason"))
    return accounts.failures_since(calls, ["caller"], F.lit(200))


@query(f"""WITH {S.RUNS_SQL} SELECT run_id, CAST(CASE WHEN finished_at IS NULL THEN greatest(epoch(started_at) + 5400 - epoch(TIMESTAMP '1998-01-01'), 0) END AS BIGINT) AS seconds_left, finished_at IS NULL AND epoch(started_at) + 5400 <= epoch(TIMESTAMP '1998-01-01') AS expired FROM runs""")
def scan_deadlines(spark, sf_dir):
    r = S.runs(spark, sf_dir)
    r = r.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    return accounts.deadlines(r, F.lit("1998-01-01").cast("timestamp"), 90).select("run_id", "seconds_left", "expired")


@query(f"""WITH {S.LEDGER_SQL}, m AS (SELECT org_id, sum(cost_usd) / 40000000.0 AS ratio FROM ledger WHERE recorded_at >= TIMESTAMP '1996-01-01' GROUP BY org_id) SELECT org_id, CASE WHEN ratio >= 0.8 AND ratio < 1 THEN round(ratio, 9) END AS warning FROM m""")
def budget_warnings(spark, sf_dir):
    """The share of the budget spent since a day, where it is close to used up."""
    m = history.priced_rows(S.ledger(spark, sf_dir)).where("recorded_at >= TIMESTAMP '1996-01-01'").groupBy("org_id").agg(F.sum("cost_usd").alias("spent"))
    return m.select("org_id", F.round(text.budget_ratio_warning(F.col("spent"), F.lit(40000000.0)), 9).alias("warning"))


#: Changed files from documents: five to a commit, some below skipped or generated folders, some commits with a bad hash.
CHANGED_SQL = """cf AS (SELECT CASE WHEN (doc_id // 5) % 13 = 0 THEN 'bad' || (doc_id // 5) ELSE sha256('c' || (doc_id // 5))[1:40] END AS "commit",
  CASE doc_id % 11 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'app/locales/' WHEN 2 THEN 'lib/dist/' WHEN 3 THEN '"odd/' ELSE 'src/' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' ELSE '.go' END AS path, doc_id, text FROM documents)"""


def changed_files(spark, sf_dir):
    i, c = F.col("doc_id"), F.floor(F.col("doc_id") / 5)
    commit = F.when(c % 13 == 0, F.concat(F.lit("bad"), c.cast("string"))).otherwise(F.substring(F.sha2(F.concat(F.lit("c"), c.cast("string")), 256), 1, 40))
    folder = F.when(i % 11 == 0, "src/tests/").when(i % 11 == 1, "app/locales/").when(i % 11 == 2, "lib/dist/").when(i % 11 == 3, '"odd/').otherwise("src/")
    ending = F.when(i % 4 == 0, ".ts").when(i % 4 == 1, ".PY").when(i % 4 == 2, ".md").otherwise(".go")
    return table(spark, sf_dir, "documents").select(commit.alias("commit"), F.concat(folder, i.cast("string"), ending).alias("path"), i.alias("doc_id"), "text")


OK_SQL = f"(regexp_matches(path, {Q(corpora.CODE)}) AND NOT regexp_matches(path, {Q(corpora.SKIP)}))"


@query(f"""WITH {CHANGED_SQL}, k AS (SELECT "commit", path, {OK_SQL} AS ok, regexp_matches(path, {Q(corpora.GENERATED)}) AS made FROM cf), g AS (SELECT "commit", count(*) FILTER (ok) AS a, count(*) FILTER (ok AND NOT made) AS w, count(*) FILTER (starts_with(path, '"')) AS quoted FROM k GROUP BY ALL)
SELECT "commit", NOT regexp_matches("commit", '^[0-9a-f]{{40}}$') AS malformed, regexp_matches("commit", '^[0-9a-f]{{40}}$') AND a > 0 AS population, regexp_matches("commit", '^[0-9a-f]{{40}}$') AND w > 0 AS kept, regexp_matches("commit", '^[0-9a-f]{{40}}$') AND a > 0 AND w = a AS strict, quoted FROM g""")
def path_population(spark, sf_dir):
    return corpora.population(changed_files(spark, sf_dir).select("commit", "path"))


@query(f"""WITH {CHANGED_SQL}, l AS (SELECT "commit", path, CASE doc_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END || unnest(string_split(text, chr(10))) AS line FROM cf),
s AS (SELECT "commit", count(*) FILTER (regexp_matches(line, '^[+-]') AND NOT regexp_matches(line, '^(?:\\+\\+\\+|---)')) AS changed_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM l WHERE {OK_SQL} GROUP BY ALL),
c AS (SELECT "commit", count(*) AS all_files, count(*) FILTER ({OK_SQL}) AS files FROM cf GROUP BY ALL) SELECT c.*, coalesce(changed_lines, 0) AS changed_lines, coalesce(bytes, 0) AS bytes FROM c LEFT JOIN s USING ("commit")""")
def candidate_extraction(spark, sf_dir):
    f = changed_files(spark, sf_dir)
    sign = F.when(F.col("doc_id") % 3 == 0, "+").when(F.col("doc_id") % 3 == 1, "-").otherwise("")
    lines = f.select("commit", "path", sign.alias("s"), F.explode(F.split("text", "\n", -1)).alias("l")).select("commit", "path", F.concat("s", "l").alias("line"))
    return corpora.candidates(f.select("commit", "path"), lines)


@query(f"""WITH {CHANGED_SQL}, p AS (SELECT "commit", path, ['idor', 'auth-bypass', 'admin-check'][doc_id % 3 + 1] AS class, doc_id % 50 + 1 AS first, doc_id % 50 + 9 AS last, doc_id % 50 + 3 AS "primary" FROM cf WHERE {OK_SQL}),
s AS (SELECT DISTINCT "commit"[1:12] AS short, CASE WHEN ascii("commit") % 2 = 0 THEN 'idor' ELSE 'auth-bypass' END AS class FROM cf WHERE ascii("commit") % 5 <> 0)
SELECT p.*, s.class AS second_class, p.class IS DISTINCT FROM s.class AS contested, count(*) OVER (PARTITION BY "commit") - 1 AS siblings FROM p LEFT JOIN s ON s.short = p."commit"[1:12]""")
def pair_assembly(spark, sf_dir):
    f, i, a = changed_files(spark, sf_dir), F.col("doc_id"), F.ascii("commit")
    kind = F.element_at(F.array(*map(F.lit, ["idor", "auth-bypass", "admin-check"])), (i % 3 + 1).cast("int"))
    pairs = f.where(corpora.admitted(F.col("path"))).select("commit", "path", kind.alias("class"), (i % 50 + 1).alias("first"), (i % 50 + 9).alias("last"), (i % 50 + 3).alias("primary"))
    second = f.where(a % 5 != 0).select(F.substring("commit", 1, 12).alias("short"), F.when(a % 2 == 0, "idor").otherwise("auth-bypass").alias("class")).distinct()
    return corpora.assembled(pairs, second)


@query("""SELECT lang, count(*) AS requests, CAST(sum(length(source)) AS BIGINT) AS system_chars, CAST(sum(length(text)) AS BIGINT) AS user_chars, max(length(source) + length(text)) AS longest, CAST(sum(length(source) + length(text)) AS BIGINT) AS total_chars, CAST(floor(sum(length(source) + length(text)) / 3.5 + 0.5) AS BIGINT) AS estimated_tokens FROM documents GROUP BY lang""")
def request_volume(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("system"), F.col("text").alias("user"))
    return corpora.volume(d, ["lang"])


#: Recorded streams from events: ten lines to a run, with tool calls of several kinds and a result at the end of most.
COMMANDS = ["git log -1", "git show HEAD:a.ts | git diff", "rm -rf x", "git diff --no-index a b", "git show ../../x", "git status", ""]
REFUSED = "long_context_credits_required"
STREAM_SQL = f"""st AS (SELECT event_id // 10 AS run, event_id % 10 AS pos, event_id AS i, CASE WHEN event_id % 10 = 9 AND event_id % 7 <> 0 THEN
    '{{"type":"result","subtype":"' || CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'success' END || '","num_turns":' || (event_id % 5) || ',"total_cost_usd":0.5' || CASE WHEN event_id % 4 <> 0 THEN ',"modelUsage":{{"m' || (event_id % 2) || '":{{}}}}' ELSE '' END
      || ',"result":"' || CASE WHEN event_id // 10 % 5 = 0 THEN 'Input is too long for requested model' ELSE 'done' END || '","usage":{{"input_tokens":' || event_id || ',"output_tokens":7,"cache_read_input_tokens":3}}}}'
  WHEN event_id % 10 = 4 THEN '{{"type":"system","subtype":"compact_boundary"}}' WHEN event_id % 10 = 5 THEN 'not json'
  WHEN event_id % 10 = 2 AND event_id // 10 % 3 <> 0 THEN '{{"type":"system","subtype":"init","tools":["Read","T' || (event_id % 4) || '"]}}'
  WHEN event_id % 10 = 6 AND event_id // 10 % 4 = 1 THEN '{{"type":"assistant","is_api_error_message":true,"api_error":"' || CASE WHEN event_id // 10 % 8 = 1 THEN '{REFUSED}' ELSE '' END || '","message":{{"content":[{{"type":"text","text":"Prompt is too long: ' || event_id || '"}}]}}}}'
  WHEN event_id % 10 = 6 AND event_id // 10 % 4 = 2 THEN '{{"type":"assistant","message":{{"content":[{{"type":"text","text":"the prompt is too long"}}]}}}}' ELSE
    '{{"type":"assistant","message":{{"content":[{{"type":"text","text":"x"}},{{"type":"tool_use","name":"' || ['Read', 'Bash', 'Write', 'Grep'][event_id % 4 + 1] || '","input":{{"' || CASE WHEN event_id % 4 = 1 THEN 'command":"' || [{', '.join(map(Q, COMMANDS))}][event_id % 7 + 1] ELSE 'file_path":"' || ['src/a.ts', '../x', 'a/../b', '~/k', '/etc/p'][event_id % 5 + 1] END || '"}}}}]}}}}' END AS line FROM events)"""


def streams(spark, sf_dir):
    i, run = F.col("event_id"), F.floor(F.col("event_id") / 10)
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    models = F.when(i % 4 != 0, F.concat(F.lit(',"modelUsage":{"m'), (i % 2).cast("string"), F.lit('":{}}'))).otherwise("")
    result = F.concat(F.lit('{"type":"result","subtype":"'), F.when(i % 3 == 0, "error").otherwise("success"), F.lit('","num_turns":'), (i % 5).cast("string"), F.lit(',"total_cost_usd":0.5'), models, F.lit(',"result":"'), F.when(run % 5 == 0, "Input is too long for requested model").otherwise("done"), F.lit('","usage":{"input_tokens":'), i.cast("string"), F.lit(',"output_tokens":7,"cache_read_input_tokens":3}}'))
    given = F.when(i % 4 == 1, F.concat(F.lit('command":"'), pick(COMMANDS, i % 7))).otherwise(F.concat(F.lit('file_path":"'), pick(["src/a.ts", "../x", "a/../b", "~/k", "/etc/p"], i % 5)))
    call = F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"x"},{"type":"tool_use","name":"'), pick(["Read", "Bash", "Write", "Grep"], i % 4), F.lit('","input":{"'), given, F.lit('"}}]}}'))
    init = F.concat(F.lit('{"type":"system","subtype":"init","tools":["Read","T'), (i % 4).cast("string"), F.lit('"]}'))
    refused = F.concat(F.lit('{"type":"assistant","is_api_error_message":true,"api_error":"'), F.when(run % 8 == 1, REFUSED).otherwise(""), F.lit('","message":{"content":[{"type":"text","text":"Prompt is too long: '), i.cast("string"), F.lit('"}]}}'))
    prose = F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"the prompt is too long"}]}}')
    line = F.when((i % 10 == 9) & (i % 7 != 0), result).when(i % 10 == 4, '{"type":"system","subtype":"compact_boundary"}').when(i % 10 == 5, "not json").when((i % 10 == 2) & (run % 3 != 0), init).when((i % 10 == 6) & (run % 4 == 1), refused).when((i % 10 == 6) & (run % 4 == 2), prose).otherwise(call)
    return table(spark, sf_dir, "events").select(run.alias("run"), (i % 10).alias("pos"), line.alias("line"))


CALLS_SQL = STREAM_SQL + """, calls AS (SELECT run, pos, i, ['Read', 'Bash', 'Write', 'Grep'][i % 4 + 1] AS name, i % 7 AS c, i % 5 AS p FROM st WHERE line LIKE '%tool_use%')"""


WHY_SQL = "[x FOR x IN [CASE WHEN name = 'Write' THEN 'tool' END, CASE WHEN name <> 'Bash' AND p IN (1, 3, 4) THEN 'path' END, CASE WHEN name = 'Bash' AND c IN (2, 6) THEN 'command' END, CASE WHEN name = 'Bash' AND c IN (3, 4) THEN 'argument' END] IF x IS NOT NULL]"


@query(f"""WITH {CALLS_SQL}, w AS (SELECT run, {WHY_SQL} AS why FROM calls) SELECT run, count(*) AS calls, count(*) FILTER (len(why) > 0) AS voiding, {', '.join(f"count(*) FILTER (list_contains(why, '{k}')) AS {k}_cases" for k in corpora.VOIDING)} FROM w GROUP BY run""")
def tool_call_audit(spark, sf_dir):
    """Calls of every run, those that void it, and how often each case holds."""
    calls = corpora.tool_calls(streams(spark, sf_dir))
    cases = [f"{k}_cases" for k in corpora.VOIDING]
    bad = corpora.voiding(calls).groupBy("run").agg(F.count("*").alias("voiding"), *(F.count_if(F.array_contains("why", k)).alias(c) for k, c in zip(corpora.VOIDING, cases)))
    return calls.groupBy("run").agg(F.count("*").alias("calls")).join(bad, "run", "left").select("run", "calls", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("voiding", *cases)))


@query(f"""WITH {STREAM_SQL}, g AS (SELECT run, max(CASE WHEN line LIKE '%"type":"result"%' THEN i END) AS i, count(*) FILTER (line LIKE '%compact_boundary%') AS compactions, max(CASE WHEN line LIKE '%is_api_error_message%' THEN i END) AS e, max(CASE WHEN line LIKE '%"init"%' THEN i END) AS t FROM st WHERE line <> 'not json' GROUP BY run),
o AS (SELECT *, i IS NOT NULL AND i % 3 <> 0 AND i % 4 <> 0 AS ok FROM g)
SELECT run, ok, CASE WHEN i IS NULL THEN 'no result event in the stream' WHEN i % 3 = 0 THEN 'result subtype error' WHEN i % 4 = 0 THEN 'the result reports no modelUsage' END AS reason, CAST(i % 5 AS INTEGER) AS turns,
CASE WHEN i IS NOT NULL THEN 0.5 END AS cost_usd, CASE WHEN i % 4 <> 0 THEN 'm' || (i % 2) ELSE '' END AS models, compactions,
CASE WHEN i % 3 = 0 THEN CASE WHEN e IS NOT NULL AND run % 8 = 1 THEN '{REFUSED}' WHEN e IS NOT NULL THEN 'Prompt is too long: ' || e WHEN run % 5 = 0 THEN 'Input is too long for requested model' END END AS size_refusal,
'Read,T' || (t % 4) AS tools, CASE WHEN ok THEN i END AS input_tokens, CASE WHEN ok THEN 7 END::BIGINT AS output_tokens, CASE WHEN ok THEN 0 END::BIGINT AS cache_write_tokens, CASE WHEN ok THEN 3 END::BIGINT AS cache_read_tokens FROM o""")
def recorded_runs(spark, sf_dir):
    return corpora.run_results(streams(spark, sf_dir))
