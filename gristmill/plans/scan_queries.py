"""Queries over contents: matching, filters, pairing, findings, reports, diffs, rewrites and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.catalog import REDACTED, Pattern, patterns
from gristmill.functions.globs import glob_regex
from gristmill.operators import diffs, experiments, files, findings, matching, pairing, routes, sqli, verdicts
from gristmill.plans import stand_ins as S
from gristmill.runtime import table
from gristmill.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LICENSE = r"(?m)^Licensed under the [A-Z][^\n]*\.?$"
Q = S.sql_literal
DETECTOR_CASE = "CASE type " + " ".join(f"WHEN {Q(t)} THEN {Q(d)}" for t, d in findings.DETECTORS.items()) + " END"
RANK_CASE = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"


query = S.registrar(QUERIES, ORACLE_SQL)


def admitted(p: Pattern) -> str:
    """SQL for the gates of a pattern."""
    ok = ["true"]
    if p.langs:
        ok.append("lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN (" + ", ".join(map(Q, p.langs + (("mjs", "cjs") if "js" in p.langs else ()))) + ")")
    if p.gate == "python":
        ok.append("lower(path) LIKE '%.py'")
    if p.gate == "remix":
        ok.append("(regexp_matches(path, '(?:^|/)routes/') OR regexp_matches(path, '(?:^|/)app/root\\.tsx?$'))")
    if p.id in ("express_route_def", "app_router_route_def", "remix_handler_def"):
        ok.append("lower(path) NOT LIKE '%.py'")
    return " AND ".join(ok)


def earliest_sql(ps: list[Pattern]) -> str:
    """hits(path, content, pos, ord): the earliest admitted match of each file."""
    cases = []
    for p in ps:
        at = f"length(string_split_regex(content, {Q(p.regex)})[1]) + 1"
        if p.lead:
            at = f"({at} + CASE WHEN substring(content, {at}, 1) IN (chr(10), chr(13)) THEN 1 ELSE 0 END)"
        cases.append(f"CASE WHEN {admitted(p)} AND regexp_matches(content, {Q(p.regex)}) THEN ({at}) * 1000 + {p.ord} END")
    return f"coded AS (SELECT path, content, least({', '.join(cases)}) AS k FROM files), hits AS (SELECT path, content, k // 1000 AS pos, k % 1000 AS ord FROM coded)"


def names_sql(ps: list[Pattern]) -> str:
    return S.values("names", "ord, pattern_id, tier", [(p.ord, p.id, p.tier) for p in ps])


LINE_OF = "CAST(length(substring(content, 1, pos - 1)) - length(replace(substring(content, 1, pos - 1), chr(10), '')) + 1 AS INTEGER)"
REASON_SQL = f"""CASE WHEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) NOT IN ({', '.join(map(Q, ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py', 'go', 'rb', 'java', 'kt')))}) THEN 'unsupported_language'
  WHEN regexp_matches(path, {Q(files.SKIP_SEGMENT)}) OR regexp_matches(path, {Q(files.SKIP_FILE)}) THEN 'skipped_path' WHEN regexp_matches(content, {Q(files.SERVER_ONLY)}) THEN 'server_only'
  WHEN NOT has_hit THEN 'no_pattern' END"""
SECRETS = patterns("secrets-exposure")


@query(f"WITH {S.DOCUMENTS_SQL}, {earliest_sql(SECRETS)} SELECT path, CAST(pos IS NOT NULL AS INTEGER) AS hits, CASE WHEN pos IS NULL THEN 'no_pattern' ELSE 'flagged' END AS outcome FROM hits")
def scan_outcomes(spark, sf_dir):
    """Flagship: one row per document with the outcome of the secret scan."""
    hit = matching.earliest_hit(S.document_files(spark, sf_dir), SECRETS)
    return hit.select("path", F.col("hit").isNotNull().cast("int").alias("hits"), F.when(F.col("hit").isNull(), "no_pattern").otherwise("flagged").alias("outcome"))


@query(f"WITH {S.DOCUMENTS_SQL}, {earliest_sql(SECRETS)}, {names_sql(SECRETS)} SELECT path, pattern_id, CAST(pos AS INTEGER) AS pos, {LINE_OF} AS line FROM hits JOIN names USING (ord)")
def secret_hits_earliest(spark, sf_dir):
    hit = matching.earliest_hit(S.document_files(spark, sf_dir), SECRETS).where("hit IS NOT NULL")
    return hit.select("path", "hit.pattern_id", "hit.pos", "hit.line")


def every_match_sql(ps: list[Pattern]) -> str:
    one = lambda p: f"""SELECT path, {Q(p.role)} AS role, {Q(p.id)} AS pattern_id, {p.ord} AS ord, content, m[i] AS match,
      CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + 1 AS BIGINT) AS pos
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT path, content, regexp_extract_all(content, {Q(p.regex)}) AS m, string_split_regex(content, {Q(p.regex)}) AS s FROM files WHERE {admitted(p)} AND regexp_matches(content, {Q(p.regex)})))"""  # noqa: E731
    return "found AS (" + " UNION ALL ".join(map(one, ps)) + f"), matches AS (SELECT *, {LINE_OF} AS line FROM found)"


@query(f"WITH {S.DOCUMENTS_SQL}, {every_match_sql(SECRETS)} SELECT path, pattern_id, CAST(pos AS INTEGER) AS pos, line, match FROM matches")
def secret_hits_all(spark, sf_dir):
    return matching.all_hits(S.document_files(spark, sf_dir), SECRETS).select("path", "pattern_id", "pos", "line", "match")


@query(f"WITH {S.DOCUMENTS_SQL}, {every_match_sql(SECRETS)} SELECT path, arg_min(pattern_id, pos * 1000 + ord) AS pattern_id, CAST(min(pos) AS INTEGER) AS pos FROM matches WHERE NOT regexp_matches(match, {Q(REDACTED)}) GROUP BY path")
def secret_hits_unredacted(spark, sf_dir):
    return matching.unredacted_hit(S.document_files(spark, sf_dir), SECRETS).select("path", "pattern_id", "pos")


@query(f"SELECT lang, count(*) AS files, count(*) FILTER (WHERE regexp_matches(text, {Q(LICENSE)})) AS licensed FROM documents GROUP BY lang")
def license_line_census(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(F.col("text").rlike(LICENSE)).alias("licensed"))


IDOR = patterns("idor")


@query(f"WITH {S.DOCUMENT_SNIPPETS_SQL}, seen AS (SELECT *, {' OR '.join(f'({admitted(p)} AND regexp_matches(content, {Q(p.regex)}))' for p in IDOR)} AS has_hit FROM files) SELECT path, {REASON_SQL} AS reason FROM seen")
def path_skip_reason(spark, sf_dir):
    hit = F.lit(False)
    for p in IDOR:
        hit = hit | (files.allowed(p, F.col("path")) & F.col("content").rlike(p.regex))
    return S.document_snippets(spark, sf_dir).select("path", files.prefilter_reason(F.col("path"), F.col("content"), hit.cast("int")).alias("reason"))


AUTH = patterns("auth-bypass")
LINES_SQL = "lines AS (SELECT path, unnest(string_split_regex(content, '\\r?\\n')) AS content, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line FROM files)"
FIRST_SQL = "first AS (SELECT path, line, content, least(" + ", ".join(f"CASE WHEN {admitted(p)} AND regexp_matches(content, {Q(p.regex)}) THEN {p.ord} END" for p in AUTH) + ") AS ord FROM lines)"


@query(f"WITH {S.DOCUMENT_SNIPPETS_SQL}, {LINES_SQL}, {FIRST_SQL}, {names_sql(AUTH)} SELECT path, CAST(line AS INTEGER) AS line, pattern_id, CAST(ord AS INTEGER) AS ord, substring(trim(content), 1, 200) AS text FROM first JOIN names USING (ord)")
def line_first_pattern(spark, sf_dir):
    return matching.line_hits(S.document_snippets(spark, sf_dir), AUTH)


@query(f"""WITH {S.DOCUMENT_SNIPPETS_SQL}, {LINES_SQL}, {FIRST_SQL}, {names_sql(AUTH)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY NOT (pattern_id LIKE '%route_def' OR pattern_id LIKE '%handler_def'), line, ord) AS r FROM first JOIN names USING (ord))
SELECT path, CAST(line AS INTEGER) AS line, pattern_id FROM ranked WHERE r = 1""")
def trigger_selection(spark, sf_dir):
    return matching.preferred_trigger(matching.line_hits(S.document_snippets(spark, sf_dir), AUTH))


TRIGGERS = {d: patterns(d) for d in ("admin-check", "env-exposure", "webhook-unverified")}


@query(f"WITH {S.DOCUMENT_SNIPPETS_SQL}, " + " UNION ALL ".join(["r AS (SELECT '' AS detector, '' AS path, '' AS pattern_id, '' AS tier, 0 AS pos, 0 AS line WHERE false"] + [f"SELECT * FROM (WITH {earliest_sql(ps)}, {names_sql(ps)} SELECT {Q(d)}, path, pattern_id, tier, CAST(pos AS INTEGER), {LINE_OF} FROM hits JOIN names USING (ord))" for d, ps in TRIGGERS.items()]) + ") SELECT * FROM r")
def earliest_trigger(spark, sf_dir):
    out = None
    for d, ps in TRIGGERS.items():
        one = matching.earliest_hit(S.document_snippets(spark, sf_dir), ps).where("hit IS NOT NULL").select(F.lit(d).alias("detector"), "path", "hit.pattern_id", "hit.tier", "hit.pos", "hit.line")
        out = one if out is None else out.unionByName(one)
    return out


PAIRS_SQL = """best AS (SELECT path, role, line, min(ord::BIGINT * 1000000000 + pos) AS k FROM {hits} GROUP BY ALL),
near AS (SELECT s.path, s.line AS sink_line, s.k AS sink_k, o.line AS source_line, o.k AS source_k, abs(s.line - o.line) AS distance,
  row_number() OVER (PARTITION BY s.path, s.line ORDER BY abs(s.line - o.line), o.k, o.line) AS r FROM best s JOIN best o ON s.path = o.path AND s.role = 'sink' AND o.role = 'source' AND abs(s.line - o.line) <= 200),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sink_line) - 1 AS pair_index, count(*) OVER (PARTITION BY path) AS n FROM near WHERE r = 1)"""


@query(f"""WITH {S.DOCUMENT_SNIPPETS_SQL}, {every_match_sql(IDOR)}, {PAIRS_SQL.format(hits='matches')}, {S.values('ids', 'role, ord, pattern_id', [(p.role, p.ord, p.id) for p in IDOR])}
SELECT path, CAST(pair_index AS INTEGER) AS pair_index, a.pattern_id AS source_id, source_line, b.pattern_id AS sink_id, sink_line, CAST(distance AS INTEGER) AS distance, greatest(n - 12, 0) AS truncated
FROM ranked JOIN ids a ON a.role = 'source' AND a.ord = source_k // 1000000000 JOIN ids b ON b.role = 'sink' AND b.ord = sink_k // 1000000000 WHERE pair_index < 12""")
def source_sink_pairs(spark, sf_dir):
    return pairing.nearest_pairs(matching.all_hits(S.document_snippets(spark, sf_dir), IDOR))


@query(f"""WITH h AS (SELECT l_suppkey AS path, CASE WHEN l_returnflag = 'R' THEN 'sink' ELSE 'source' END AS role, l_partkey % 3 AS ord, CAST(l_orderkey AS BIGINT) AS pos, CAST(l_orderkey % 5000 AS INTEGER) AS line FROM lineitem),
{PAIRS_SQL.format(hits='h')} SELECT path, CAST(pair_index AS INTEGER) AS pair_index, source_line, sink_line, CAST(distance AS INTEGER) AS distance, greatest(n - 12, 0) AS truncated FROM ranked WHERE pair_index < 12""")
def source_sink_pairs_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "R", "sink").otherwise("source")
    hits = li.select(F.col("l_suppkey").alias("path"), role.alias("role"), (F.col("l_partkey") % 3).alias("ord"), F.col("l_orderkey").alias("pos"), (F.col("l_orderkey") % 5000).cast("int").alias("line"), F.lit("p").alias("pattern_id"))
    return pairing.nearest_pairs(hits, counted=li.count()).drop("source_id", "sink_id")


#: Findings derived from documents: a path, a line, a type and a severity.
FINDINGS_SQL = f"""base AS (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'src/a' WHEN 1 THEN 'lib/a' ELSE 'src/b/c' END, '/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.py' END) AS path,
  CAST(n_chars % 300 + 1 AS INTEGER) AS start_line, CAST(n_chars % 300 + 1 + doc_id % 4 AS INTEGER) AS end_line,
  [{', '.join(Q(t) for t, _, _ in findings.REGISTRY)}][doc_id % 11 + 1] AS type, ['low', 'medium', 'high', 'critical'][n_chars % 4 + 1] AS severity, CAST(doc_id % 5 AS INTEGER) AS tenant, 'm' || doc_id AS message FROM documents)"""


def derived_findings(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int"))
    folder = F.when(d % 3 == 0, "src/a").when(d % 3 == 1, "lib/a").otherwise("src/b/c")
    start = (F.col("n_chars") % 300 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), d.cast("string"), F.when(d % 2 == 0, ".ts").otherwise(".py")).alias("path"), start.alias("start_line"), (start + d % 4).cast("int").alias("end_line"), pick([t for t, _, _ in findings.REGISTRY], d % 11 + 1).alias("type"), pick(["low", "medium", "high", "critical"], F.col("n_chars") % 4 + 1).alias("severity"), (d % 5).cast("int").alias("tenant"), F.concat(F.lit("m"), d.cast("string")).alias("message"))


@query(f"""WITH {FINDINGS_SQL}, changed AS (SELECT path, [CAST(doc_id % 37 AS INTEGER), CAST(doc_id % 301 AS INTEGER), 90] AS lines FROM base WHERE doc_id % 4 <> 0)
SELECT doc_id, path, start_line, end_line, CASE WHEN c.path IS NULL THEN true ELSE len(list_filter(lines, lambda x: x BETWEEN start_line - 5 AND greatest(start_line, end_line) + 40)) > 0 END AS introduced FROM base b LEFT JOIN changed c USING (path)""")
def introduced_vs_preexisting(spark, sf_dir):
    f = derived_findings(spark, sf_dir).select("doc_id", "path", "start_line", "end_line")
    d = F.col("doc_id")
    changed = f.where(d % 4 != 0).select("path", F.array((d % 37).cast("int"), (d % 301).cast("int"), F.lit(90)).alias("changed"))
    return findings.partition_by_change(f, changed, ["path"])


SETTINGS = [(t, th, [glob_regex(g) for g in globs], on) for t, th, globs, on in S.SETTINGS]
TENANT_SQL = f"""WITH {FINDINGS_SQL}, {S.values('settings', 'tenant, threshold, globs, enabled', [(t, th, g, on if on is not None else None) for t, th, g, on in SETTINGS])},
joined AS (SELECT base.*, threshold, globs, enabled, list_filter(enabled::VARCHAR[], lambda x: x IN ({', '.join(map(Q, findings.DETECTORS.values()))})) AS known, {DETECTOR_CASE} AS detector FROM base LEFT JOIN settings USING (tenant)),
dropped AS (SELECT *, CASE WHEN {RANK_CASE.format('severity')} < {RANK_CASE.format("coalesce(threshold, 'low')")} THEN 'severity'
  WHEN len(list_filter(globs, lambda g: regexp_matches(path, g))) > 0 THEN 'glob'
  WHEN enabled IS NOT NULL AND (len(enabled) = 0 OR (len(known) > 0 AND detector IS NOT NULL AND NOT list_contains(known, detector))) THEN 'detector' END AS drop_reason FROM joined)"""


@query(TENANT_SQL + " SELECT doc_id, tenant, path, type, severity, drop_reason FROM dropped")
def tenant_filter_reasons(spark, sf_dir):
    settings = S.inline(spark, "tenant int, threshold string, globs array<string>, enabled array<string>", SETTINGS)
    return findings.tenant_filter(derived_findings(spark, sf_dir), settings).select("doc_id", "tenant", "path", "type", "severity", "drop_reason")


@query(TENANT_SQL + " SELECT tenant, count(*) AS findings, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason = 'severity') AS by_severity, count(*) FILTER (drop_reason = 'glob') AS by_glob, count(*) FILTER (drop_reason = 'detector') AS by_detector FROM dropped GROUP BY tenant")
def tenant_filter_counts(spark, sf_dir):
    c = lambda r: F.count_if(F.coalesce(F.col("drop_reason") == r, F.lit(False)))
    return tenant_filter_reasons(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("findings"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), c("severity").alias("by_severity"), c("glob").alias("by_glob"), c("detector").alias("by_detector"))


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, type FROM base WHERE type NOT IN ({', '.join(map(Q, findings.SUPPRESSED))})")
def suppressed_types(spark, sf_dir):
    return findings.unsuppressed(derived_findings(spark, sf_dir)).select("doc_id", "type")


@query(f"""WITH {FINDINGS_SQL}, {S.values('reg', 'type, cwe, owasp', findings.REGISTRY)}
SELECT doc_id, concat_ws(':', {DETECTOR_CASE}, type, path, start_line) AS finding_id, {DETECTOR_CASE} AS detector, cwe, owasp, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM base JOIN reg USING (type)""")
def registry_lookup(spark, sf_dir):
    f = findings.with_registry(derived_findings(spark, sf_dir))
    return f.select("doc_id", findings.finding_id(F.col("detector"), F.col("type"), F.col("path"), F.col("start_line")).alias("finding_id"), "detector", "cwe", "owasp", "level")


@query(f"WITH {FINDINGS_SQL} SELECT tenant, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM base GROUP BY tenant")
def severity_breakdown(spark, sf_dir):
    return findings.severity_breakdown(derived_findings(spark, sf_dir), ["tenant"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id, ts FROM r WHERE k = 1""")
def dedupe_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return findings.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT event_type || '-' || k AS family, sum(n) AS findings FROM (SELECT event_type, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS n FROM (SELECT event_type, CAST(props AS JSON)::MAP(VARCHAR, BIGINT) AS m FROM events)) GROUP BY ALL HAVING sum(n) > 0""")
def findings_by_family(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.map_from_entries(F.transform(F.map_entries(F.from_json("props", "map<string,bigint>")), lambda x: F.struct(F.concat_ws("-", "event_type", x["key"]), x["value"]))).alias("findings_by_family"))
    return findings.family_totals(e)


@query(f"""WITH {S.values('asked', 'request_key, pair_index, family, route_trigger', S.ASKED)}, {S.values('v', 'request_key, pair_index, place, is_vulnerable, confidence, caller, operation', S.VERDICTS)},
valid AS (SELECT request_key, pair_index, place, is_vulnerable, lower(confidence) AS confidence, CASE WHEN lower(caller) IN ('authenticated', 'unauthenticated') THEN lower(caller) ELSE 'unclear' END AS caller_auth,
  CASE WHEN lower(operation) IN ('administrative', 'ordinary') THEN lower(operation) ELSE 'unclear' END AS operation_class FROM v WHERE is_vulnerable IS NOT NULL AND lower(confidence) IN ('high', 'medium', 'low')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_key, pair_index ORDER BY place) AS r FROM valid) WHERE r = 1)
SELECT a.request_key, a.family, f.confidence, CASE WHEN f.request_key IS NULL THEN 'unjudged' WHEN NOT is_vulnerable THEN 'safe' WHEN confidence = 'low' THEN 'low'
  WHEN (family = 'idor' AND (caller_auth = 'unauthenticated' OR operation_class = 'administrative')) OR (family = 'auth-bypass' AND route_trigger AND caller_auth = 'authenticated' AND operation_class = 'administrative') THEN 'deferred'
  WHEN confidence = 'medium' THEN 'review-queue' ELSE 'emitted' END AS outcome FROM asked a LEFT JOIN f USING (request_key, pair_index)""")
def verdict_gate(spark, sf_dir):
    asked = S.inline(spark, "request_key string, pair_index int, family string, route_trigger boolean", S.ASKED)
    v = S.inline(spark, "request_key string, pair_index int, place int, is_vulnerable boolean, confidence string, caller_auth string, operation_class string", S.VERDICTS)
    return verdicts.gate(verdicts.attach(asked, v)).select("request_key", "family", "confidence", "outcome")


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT tenant, CAST(start_line % 7 AS BIGINT) AS scan, count(*) FILTER (severity <> 'low') AS classified, count(*) FILTER (severity = 'critical' AND doc_id % 3 = 0) AS fixes, count(*) FILTER (doc_id % 17 = 0) AS errors,
  count(*) FILTER (doc_id % 23 = 0) AS low_quality, count(*) FILTER (doc_id % 29 = 0) > 0 AS warned, count(*) FILTER (doc_id % 31 = 0) AS calls_failed, count(*) FILTER (doc_id % 41 = 0) AS detectors_failed FROM base GROUP BY ALL),
s AS (SELECT *, CASE WHEN classified = 0 AND errors = 0 THEN 'no_action' WHEN classified > 0 AND fixes = 0 THEN 'failed' WHEN fixes > 0 AND errors > 0 THEN 'partial_success' WHEN fixes > 0 THEN 'success' ELSE 'failed' END AS status FROM g)
SELECT tenant, scan, status, CASE WHEN calls_failed > 0 OR detectors_failed > 0 THEN 'Detection coverage degraded: ' || concat_ws('; ', CASE WHEN calls_failed > 0 THEN calls_failed || ' LLM call(s) failed' END, CASE WHEN detectors_failed > 0 THEN detectors_failed || ' detector(s) threw' END) || ' — results are incomplete, do not treat as a clean scan'
  WHEN status = 'failed' THEN 'Workflow failed' WHEN status = 'partial_success' THEN 'Partial success: errors occurred during fix generation' WHEN status = 'no_action' THEN 'No classified vulnerabilities to automate'
  WHEN low_quality > 0 THEN 'Low-quality patches detected' WHEN warned THEN 'Warnings present in patches' ELSE 'All patches high/medium quality and no warnings' END AS reason FROM s""")
def workflow_status(spark, sf_dir):
    d = F.col("doc_id")
    n = lambda c: F.count_if(c)
    g = derived_findings(spark, sf_dir).groupBy("tenant", (F.col("start_line") % 7).cast("long").alias("scan")).agg(n(F.col("severity") != "low").alias("classified"), n((F.col("severity") == "critical") & (d % 3 == 0)).alias("fixes"), n(d % 17 == 0).alias("errors"), n(d % 23 == 0).alias("low_quality"), (n(d % 29 == 0) > 0).alias("warned"), n(d % 31 == 0).alias("calls_failed"), n(d % 41 == 0).alias("detectors_failed"))
    s = g.withColumn("status", findings.workflow_status(F.col("classified"), F.col("fixes"), F.col("errors")))
    return s.select("tenant", "scan", "status", findings.automation_reason(F.col("status"), F.col("low_quality"), F.col("warned"), F.col("calls_failed"), F.col("detectors_failed")).alias("reason"))


@query(f"""WITH {FINDINGS_SQL}, o AS (SELECT *, doc_id % 9 = 0 AS bad, doc_id % 50 = 0 AS aux FROM base) SELECT count(*) AS attempted, count(*) FILTER (bad) AS failed, count(*) FILTER (bad AND severity = 'high') AS failed_high, count(*) FILTER (bad AND type = 'idor_risk') AS failed_idor FROM o WHERE NOT aux""")
def coverage_accounting(spark, sf_dir):
    d = F.col("doc_id")
    calls = derived_findings(spark, sf_dir).select((d % 9 != 0).alias("ok"), F.col("severity").alias("reason"), F.col("type").alias("caller"), (d % 50 == 0).alias("auxiliary"))
    zero = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return verdicts.coverage(calls).select("attempted", "failed", zero(F.col("by_reason"), "high").alias("failed_high"), zero(F.col("by_caller"), "idor_risk").alias("failed_idor"))


@query(f"""WITH d AS (SELECT doc_id, text, coalesce(l.toxic, 0) = 1 AS actual, lang, l.doc_id IS NOT NULL AS known FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (p AND actual) AS tp, count(*) FILTER (p AND NOT actual) AS fp, count(*) FILTER (NOT p AND actual) AS fn FROM (SELECT *, regexp_matches(text, '(?i)worthless|trash|disgusting|scum|stupid') AS p FROM d WHERE known) GROUP BY lang),
w AS (SELECT *, tp + fp AS n, 1.959963984540054::DOUBLE AS z FROM g)
SELECT lang, tp, fp, fn, CASE WHEN n > 0 THEN round(tp / n, 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall,
  CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, (tp / n + z * z / (2 * n) - z * sqrt(tp / n * (1 - tp / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS precision_low,
  CASE WHEN n = 0 THEN 0 ELSE round(least(1, (tp / n + z * z / (2 * n) + z * sqrt(tp / n * (1 - tp / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS precision_high FROM w""")
def precision_recall(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").join(lab, "doc_id")
    return experiments.precision_recall(rows, ["lang"], F.col("text").rlike("(?i)worthless|trash|disgusting|scum|stupid"), F.col("toxic") == 1)


@query(f"""WITH {S.DOCUMENTS_SQL}, {every_match_sql(SECRETS)} SELECT pattern_id, count(DISTINCT path) AS files, count(DISTINCT CASE WHEN NOT m THEN path END) AS spurious_files, count(*) AS hits, count(*) FILTER (NOT m) AS spurious_hits,
round(count(DISTINCT CASE WHEN NOT m THEN path END) / count(DISTINCT path), 6) AS spurious_share FROM (SELECT *, path LIKE '%.en' AS m FROM matches) GROUP BY pattern_id""")
def pattern_specificity(spark, sf_dir):
    return experiments.specificity(matching.all_hits(S.document_files(spark, sf_dir), SECRETS), F.col("path").endswith(".en"))


@query(f"""WITH {S.DOCUMENTS_SQL}, h AS (SELECT *, {' OR '.join(f'regexp_matches(content, {Q(p.regex)})' for p in SECRETS)} AS hit, string_split(path, '/')[1] AS repo FROM files),
r AS (SELECT repo, count(*) AS files, count(*) FILTER (hit) AS hit_files FROM h GROUP BY repo),
g AS (SELECT count(*) AS repos, sum(files) AS files, count(*) FILTER (hit_files > 0) AS hit_repos, sum(hit_files) AS hit_files, 1.959963984540054::DOUBLE AS z FROM r)
SELECT repos, CAST(files AS BIGINT) AS files, hit_repos, CAST(hit_files AS BIGINT) AS hit_files,
 round(greatest(0, (hit_repos / repos + z * z / (2 * repos) - z * sqrt(hit_repos / repos * (1 - hit_repos / repos) / repos + z * z / (4 * repos * repos))) / (1 + z * z / repos)), 6) AS low,
 round(least(1, (hit_repos / repos + z * z / (2 * repos) + z * sqrt(hit_repos / repos * (1 - hit_repos / repos) / repos + z * z / (4 * repos * repos))) / (1 + z * z / repos)), 6) AS high FROM g""")
def reach(spark, sf_dir):
    d = S.document_files(spark, sf_dir)
    repo = F.get(F.split("path", "/"), F.lit(0)).alias("repo")
    hits = matching.earliest_hit(d, SECRETS).where("hit IS NOT NULL").select(repo, "path")
    return experiments.reach(d.select(repo, "path"), hits)


@query("""WITH k AS (SELECT doc_id, lang, sha256('draw-1' || source || '/' || doc_id) AS draw_key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw_key) AS rank FROM k) SELECT doc_id, lang, draw_key, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def deterministic_draw(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return experiments.draw(d, "draw-1", F.concat_ws("/", "source", "doc_id"), ["lang"], 10).select("doc_id", "lang", "draw_key", "rank")


@query("""WITH o AS (SELECT doc_id, min(lang || '~' || source) AS s FROM documents GROUP BY doc_id), d AS (SELECT doc_id, split_part(s, '~', 1) AS lang, split_part(s, '~', 2) AS source FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM d) SELECT doc_id, lang, source, CAST(rank AS INTEGER) AS rank, row_number() OVER (ORDER BY rank, lang, source) AS position FROM r WHERE rank <= 2""")
def stratified_take2(spark, sf_dir):
    return experiments.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 2)


@query("""WITH c AS (SELECT user_id, event_type, CASE WHEN value IS NULL OR value < 20 THEN 'too small' WHEN event_id % 13 = 0 THEN 'archived' END AS reason FROM events), f AS (SELECT * FROM c WHERE reason IS NULL),
o AS (SELECT user_id, min(event_type) AS event_type FROM f GROUP BY user_id), k AS (SELECT event_type, count(*) AS a FROM f GROUP BY 1), p AS (SELECT event_type, a, coalesce(b, 0) AS b FROM k LEFT JOIN (SELECT event_type, count(*) AS b FROM o GROUP BY 1) USING (event_type))
SELECT * FROM (SELECT event_type, 'kept' AS outcome, least(b, 10) AS n FROM p UNION ALL SELECT event_type, 'repeated', a - b FROM p UNION ALL SELECT event_type, 'surplus', greatest(b - 10, 0) FROM p) WHERE n > 0
UNION ALL SELECT event_type, reason, count(*) FROM c WHERE reason IS NOT NULL GROUP BY ALL""")
def selection_tally(spark, sf_dir):
    """What became of every candidate of a stratified selection of ten users an event type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    reason = F.when(F.coalesce(F.col("value") < 20, F.lit(True)), "too small").when(F.col("event_id") % 13 == 0, "archived")
    return experiments.selection_tally(e.withColumn("reason", reason), "user_id", ["event_type"], 10, F.col("reason"))


#: Targets of a paired experiment from documents, five series of them, and their verdicts: five runs each, but four for some targets of one series.
TARGETS_SQL = """t AS (SELECT doc_id % 5 AS series, ['held-out', 'development', 'clean'][doc_id // 5 % 3 + 1] AS "set", 'c' || (doc_id // 15 % 8) AS "case", CASE WHEN doc_id // 120 % 2 = 0 THEN 'parent' ELSE 'fix' END AS side, 'f' || (doc_id // 240) AS path, doc_id // 15 % 8 AS c, doc_id FROM documents),
v AS (SELECT *, CASE WHEN side = 'parent' THEN (c * 7 + run + series) % (series + 3) <> 0 ELSE (c + run) % 6 = 0 END AS emitted FROM (SELECT *, unnest(CASE WHEN series = 4 AND doc_id % 11 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2, 3, 4] END) AS run FROM t))"""


def targets(spark, sf_dir):
    d = F.col("doc_id")
    part = lambda n: F.floor(d / n)
    kind = F.element_at(F.array(*map(F.lit, ["held-out", "development", "clean"])), (part(5) % 3 + 1).cast("int"))
    c = part(15) % 8
    return table(spark, sf_dir, "documents").select(
        (d % 5).alias("series"), kind.alias("set"), F.concat(F.lit("c"), c.cast("string")).alias("case"), F.when(part(120) % 2 == 0, "parent").otherwise("fix").alias("side"), F.concat(F.lit("f"), part(240).cast("string")).alias("path"), c.alias("c"), "doc_id"
    )


@query(f"""WITH {TARGETS_SQL}, g AS (SELECT series, "set", "case", side, path, count(*) AS runs, count(*) FILTER (emitted) AS emits FROM v GROUP BY ALL),
f AS (SELECT p.series, p."set", p."case", p.path, p.runs = 5 AND x.runs = 5 AND p.emits >= 4 AND x.emits <= 1 AS hit FROM g p LEFT JOIN g x ON x.series = p.series AND x."set" = p."set" AND x."case" = p."case" AND x.path = p.path AND x.side = 'fix' WHERE p.side = 'parent'),
h AS (SELECT series, count(*) AS cases, count(*) FILTER (hit) AS hits FROM (SELECT series, "case", bool_or(coalesce(hit, false)) AS hit FROM f WHERE "set" = 'held-out' GROUP BY ALL) GROUP BY series),
w AS (SELECT series, bool_and(runs = 5) AS complete, count(*) FILTER ("set" = 'clean' AND emits >= 4) AS clean_flags, count(*) FILTER (side = 'fix' AND emits >= 4) AS fix_flags FROM g GROUP BY series)
SELECT series, complete, cases, hits, clean_flags, fix_flags, CASE WHEN NOT complete THEN 'INCOMPLETE' WHEN hits >= 4 THEN 'PASS' WHEN hits <= 1 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS recall, CASE WHEN NOT complete THEN 'INCOMPLETE' WHEN clean_flags > 3 THEN 'TOO NOISY' ELSE 'ok' END AS noise FROM w JOIN h USING (series)""")
def planned_scoring(spark, sf_dir):
    """Series of a paired experiment scored by the runs that were planned."""
    t = targets(spark, sf_dir)
    runs = F.when((F.col("series") == 4) & (F.col("doc_id") % 11 == 0), F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(4)))
    v = t.withColumn("run", F.explode(runs))
    emitted = F.when(F.col("side") == "parent", (F.col("c") * 7 + F.col("run") + F.col("series")) % (F.col("series") + 3) != 0).otherwise((F.col("c") + F.col("run")) % 6 == 0)
    return experiments.planned_scores(t, v.withColumn("emitted", emitted), 5, ["series"])


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS c FROM documents) SELECT doc_id, CAST(CASE WHEN c > 400 THEN c // 100 ELSE 1 END AS INTEGER) AS step FROM n WHERE c <= 400 OR (r - 1) % (c // 100) = 0""")
def systematic_sample(spark, sf_dir):
    return files.systematic_sample(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 400, 100).select("doc_id", F.col("step").cast("int").alias("step"))


SEGMENTS = ["en", "de", "fr", "es"]


@query("""WITH f AS (SELECT page_id // 5 AS c, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages), m AS (SELECT c, CASE WHEN list_contains(p, 'en') THEN 1 ELSE 0 END + CASE WHEN list_contains(p, 'de') THEN 2 ELSE 0 END + CASE WHEN list_contains(p, 'fr') THEN 4 ELSE 0 END + CASE WHEN list_contains(p, 'es') THEN 8 ELSE 0 END AS mask FROM f),
g AS (SELECT c, bit_or(mask) AS a, bit_and(mask) AS b, bool_and(mask <> 0) AS removed, list(mask) AS masks FROM m GROUP BY c), s AS (SELECT * FROM (VALUES ('en', 1), ('de', 2), ('fr', 4), ('es', 8)) s(segment, bit))
SELECT segment, count(*) FILTER (a & bit <> 0) AS touches, count(*) FILTER (b & bit <> 0) AS removes_alone, count(*) FILTER (removed AND list_contains(masks, bit)) AS unique_removals FROM g, s GROUP BY segment""")
def segment_ablation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("commit"), F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return experiments.ablation(pages, SEGMENTS)


#: A scanner's finding for each document; its id is the document's.
SCANNED = S.dealt_sql("dealt", "id, rule, message, meta, code, dialect", S.SCANNED_SQL) + ", f AS (SELECT doc_id AS id, rule, message, meta, code, dialect FROM dealt)"
WEAK = " OR ".join(f"contains(lower(message), {Q(w)})" for w in sqli.WEAK_WORDS)


def scanned(spark, sf_dir):
    rows = S.dealt(spark, sf_dir, "id long, rule string, message string, meta string, code string, dialect string", S.SCANNED_SQL)
    return rows.withColumn("id", F.col("doc_id")).drop("doc_id")


@query(f"""WITH {SCANNED}, s AS (SELECT id, greatest(0, CASE WHEN regexp_matches(rule, {Q(sqli.RULE_STRONG)}) THEN 42 ELSE 0 END + CASE WHEN regexp_matches(meta, {Q(sqli.CWE_89)}) THEN 38 ELSE 0 END
 + CASE WHEN regexp_matches(meta, '(?i)\\binjection\\b') AND regexp_matches(meta, '(?i)\\bsql\\b') THEN 22 ELSE 0 END + CASE WHEN regexp_matches(message, {Q(sqli.MESSAGE_STRONG)}) THEN 28 WHEN regexp_matches(message, {Q(sqli.MESSAGE_MEDIUM)}) THEN 18 ELSE 0 END
 + CASE WHEN regexp_matches(meta, '(?i)\\bowasp\\b') AND regexp_matches(meta, '(?i)\\bA0?3\\b|injection') THEN 12 ELSE 0 END + CASE WHEN regexp_matches(meta, '(?i)\\btechnology\\b') AND regexp_matches(meta, '(?i)\\bsql\\b') THEN 8 ELSE 0 END
 + CASE WHEN regexp_matches(message, '(?i)\\bsql\\b') AND regexp_matches(message, {Q(sqli.MESSAGE_TERMS)}) THEN 14 ELSE 0 END + CASE WHEN regexp_matches(message, '(?i)\\bsql\\b') AND NOT regexp_matches(message, {Q(sqli.LONE_SQL_NOT)}) THEN 4 ELSE 0 END
 - CASE WHEN regexp_matches(message, {Q(sqli.FALSE_HINT)}) THEN 25 ELSE 0 END + CASE WHEN {WEAK} THEN 3 ELSE 0 END) AS score FROM f)
SELECT id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 45 THEN 'high' WHEN score >= 28 THEN 'medium' WHEN score >= 18 THEN 'low' END AS band FROM s""")
def sqli_signal_score(spark, sf_dir):
    f = scanned(spark, sf_dir)
    score = sqli.signal_score(F.col("rule"), F.col("message"), F.col("meta"))
    return f.select("id", score.cast("int").alias("score"), sqli.score_band(score).alias("band"))


@query(f"WITH {SCANNED} SELECT 'f' || id AS path, id AS line, code AS text, 'medium' AS confidence, 20 AS score FROM f WHERE regexp_matches(code, {Q(sqli.SQL_WORD)}) AND regexp_matches(code, {Q(sqli.BUILT_TEXT)})")
def diff_line_heuristic(spark, sf_dir):
    f = scanned(spark, sf_dir)
    return sqli.risky_lines(f.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.col("id").alias("line"), F.col("code").alias("text")))


@query()
def rewrite_fix(spark, sf_dir):
    f = scanned(spark, sf_dir).select("id", "code", "dialect")
    return sqli.graded(sqli.rewrites(f))


JOIN_PATH = "CASE WHEN {a} = '<dynamic>' OR {b} = '<dynamic>' THEN '<dynamic>' ELSE CASE WHEN length({c}) > 1 THEN regexp_replace({c}, '/$', '') ELSE {c} END END"


def join_sql(a: str, b: str) -> str:
    return JOIN_PATH.format(a=a, b=b, c=f"regexp_replace(regexp_replace({a}, '/+$', '') || '/' || regexp_replace({b}, '^/+', ''), '/+', '/', 'g')")


@query(f"""WITH RECURSIVE {S.values('mounts', 'parent, child, prefix', S.MOUNTS)}, {S.values('routes', 'route_id, receiver, path, line', S.ROUTE_ROWS)},
c(receiver, top, prefix, through, seen, looped) AS (SELECT child, parent, prefix, parent, [child, parent], child = parent FROM mounts
  UNION ALL SELECT c.receiver, m.parent, {join_sql('m.prefix', 'c.prefix')}, m.parent || '>' || c.through, list_append(c.seen, m.parent), list_contains(c.seen, m.parent) FROM c JOIN mounts m ON m.child = c.top WHERE NOT c.looped),
e AS (SELECT receiver, prefix, through FROM c WHERE looped OR NOT EXISTS (SELECT 1 FROM mounts m WHERE m.child = c.top))
SELECT route_id, {join_sql("coalesce(e.prefix, '')", 'routes.path')} AS full_path, coalesce(through, '') AS through FROM routes LEFT JOIN e USING (receiver)""")
def route_mount_chains(spark, sf_dir):
    r = S.inline(spark, "route_id int, receiver string, path string, line int", S.ROUTE_ROWS)
    m = S.inline(spark, "parent string, child string, prefix string", S.MOUNTS)
    return routes.mounted_routes(r, m).select("route_id", "full_path", F.array_join("through", ">").alias("through"))


@query(f"""WITH {S.values('routes', 'route_id, receiver, path, line', S.ROUTE_ROWS)}, {S.values('uses', 'receiver, use_line, prefix, guard', S.USES)}
SELECT route_id, guard, use_line AS line FROM routes JOIN uses USING (receiver) WHERE use_line < line AND (prefix IS NULL OR prefix IN ('/', '') OR path = regexp_replace(prefix, '/+$', '') OR starts_with(path, regexp_replace(prefix, '/+$', '') || '/'))""")
def router_guards(spark, sf_dir):
    r = S.inline(spark, "route_id int, receiver string, path string, line int", S.ROUTE_ROWS)
    return routes.router_guards(r, S.inline(spark, "receiver string, line int, prefix string, guard string", S.USES))


@query(f"""WITH {S.values('f', 'path', S.LAYOUT_FILES)}, r AS (SELECT path AS route, string_split(path, '/') AS p FROM f WHERE regexp_matches(path, '(^|/)routes/')),
l AS (SELECT route, p, unnest(generate_series(list_position(p, 'routes'), len(p) - 1)) AS level FROM r),
x AS (SELECT route, level, array_to_string(p[1:level], '/') AS dir, NOT (ends_with(string_split(p[len(p)], '.')[1], '_') OR len(list_filter(p[level + 1:len(p) - 1], lambda s: NOT ends_with(s, '+') OR ends_with(s, '_+'))) > 0) AS proven FROM l),
n AS (SELECT * FROM (VALUES (0, '_layout.tsx'), (1, '_layout.ts'), (2, '_layout.jsx'), (3, '_layout.js')) n(ord, name)),
k AS (SELECT route, level, proven, dir || '/' || name AS layout, row_number() OVER (PARTITION BY route, level ORDER BY ord) AS r FROM x, n WHERE dir || '/' || name <> route AND dir || '/' || name IN (SELECT path FROM f))
SELECT route, layout, CAST(level AS INTEGER) AS level, proven FROM k WHERE r = 1""")
def guard_ancestor_walk(spark, sf_dir):
    return routes.layout_guards(S.inline(spark, "path string", S.LAYOUT_FILES))


@query(f"""WITH {S.values('nodes', 'route_id, kind, path, s, e', S.NODES)}, {S.values('w', 'path, f, l', S.WINDOWS)}, {S.values('h', 'path, f, l', S.HUNKS)}
SELECT route_id, bool_or(EXISTS (SELECT 1 FROM w WHERE w.path = n.path AND w.f <= n.e AND n.s <= w.l)) AS c1, bool_or(EXISTS (SELECT 1 FROM h WHERE h.path = n.path AND n.s <= h.f AND h.l <= n.e)) AS c2,
coalesce(list_aggregate(list_sort(list_distinct(list(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.path = n.path AND n.s <= h.f AND h.l <= n.e) THEN kind END))), 'string_agg', ','), '') AS kinds FROM nodes n GROUP BY route_id""")
def span_intersect_contain(spark, sf_dir):
    nodes = S.inline(spark, "route_id int, kind string, path string, start int, end int", S.NODES)
    return routes.span_scores(nodes, S.inline(spark, "path string, first int, last int", S.WINDOWS), S.inline(spark, "path string, first int, last int", S.HUNKS))


DIFF_SQL = f"""{S.dealt_sql('d', 'scan_id, diff', S.DIFFS, 'scan_id')}, parts AS (SELECT scan_id, unnest(string_split_regex(diff, '(?m)^diff --git ')) AS body, generate_subscripts(string_split_regex(diff, '(?m)^diff --git '), 1) - 1 AS part FROM d),
ls AS (SELECT scan_id, part, unnest(string_split_regex(body, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) AS pos FROM parts WHERE trim(body) <> ''),
h AS (SELECT *, count(*) FILTER (starts_with(line, '@@')) OVER (PARTITION BY scan_id, part ORDER BY pos) AS hunk, TRY_CAST(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)(?:,[0-9]+)? @@', 1) AS INTEGER) AS start FROM ls),
kd AS (SELECT *, CASE WHEN starts_with(line, '+++ b/') THEN 'path' WHEN starts_with(line, '@@') THEN 'hunk' WHEN hunk = 0 THEN 'before' WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'plus' WHEN starts_with(line, '-') THEN 'minus' WHEN starts_with(line, '\\') THEN 'note' ELSE 'context' END AS kind FROM h),
o AS (SELECT *, coalesce(count(*) FILTER (kind IN ('plus', 'context')) OVER (PARTITION BY scan_id, part, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, max(start) OVER (PARTITION BY scan_id, part, hunk) AS base FROM kd),
paths AS (SELECT scan_id, part, arg_max(trim(substring(line, 7)), pos) AS path FROM kd WHERE kind = 'path' GROUP BY ALL)"""


@query(f"""WITH {DIFF_SQL}, t AS (SELECT *, lag(kind, 1, '') OVER (PARTITION BY scan_id, part ORDER BY pos) AS last FROM o WHERE kind IN ('plus', 'context', 'hunk', 'minus')),
c AS (SELECT scan_id, part, CASE WHEN kind = 'minus' THEN greatest(1, coalesce(base, 1) + off) ELSE coalesce(base, 1) + off END AS n, kind FROM t WHERE kind = 'plus' OR (kind = 'minus' AND last <> 'minus'))
SELECT scan_id, path, list_aggregate(list_sort(list(DISTINCT n)), 'string_agg', ',') AS changed, bool_or(kind = 'plus') AS has_added FROM c JOIN paths USING (scan_id, part) GROUP BY scan_id, part, path""")
def diff_changed_lines(spark, sf_dir):
    c = diffs.changed_lines(S.dealt(spark, sf_dir, "scan_id string, diff string", S.DIFFS, "scan_id"))
    return c.select("scan_id", "path", F.array_join(F.transform("changed", lambda x: x.cast("string")), ",").alias("changed"), "has_added")


@query(f"""WITH RECURSIVE {DIFF_SQL}, hs AS (SELECT scan_id, part, hunk, max(start) AS start, max(CASE WHEN kind = 'plus' THEN off + 1 END) AS len FROM o WHERE hunk > 0 GROUP BY ALL),
n(scan_id, part, hunk, base, nxt) AS (SELECT scan_id, part, hunk, coalesce(start, 1), coalesce(coalesce(start, 1) + len, 1) FROM hs WHERE hunk = 1
  UNION ALL SELECT hs.scan_id, hs.part, hs.hunk, coalesce(hs.start, n.nxt), coalesce(coalesce(hs.start, n.nxt) + hs.len, n.nxt) FROM n JOIN hs ON hs.scan_id = n.scan_id AND hs.part = n.part AND hs.hunk = n.hunk + 1)
SELECT o.scan_id, path, string_agg(substring(line, 2), chr(10) ORDER BY pos) AS content, string_agg(CAST(n.base + off AS VARCHAR), ',' ORDER BY pos) AS line_map FROM o JOIN n USING (scan_id, part, hunk) JOIN paths USING (scan_id, part) WHERE kind = 'plus' GROUP BY o.scan_id, o.part, path""")
def diff_parse(spark, sf_dir):
    p = diffs.parse(S.dealt(spark, sf_dir, "scan_id string, diff string", S.DIFFS, "scan_id"))
    return p.select("scan_id", "path", "content", F.array_join(F.transform("line_map", lambda x: x.cast("string")), ",").alias("line_map"))


@query(f"""WITH {S.dealt_sql('d', 'scan_id, diff', S.DIFFS, 'scan_id')}, ls AS (SELECT scan_id, unnest(string_split_regex(diff, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(diff, '\\r?\\n'), 1) - 1 AS pos FROM d),
p AS (SELECT *, last_value(CASE WHEN starts_with(line, '--- ') THEN regexp_replace(trim(substring(line, 5)), '^a/', '') END IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY pos) AS path,
 TRY_CAST(regexp_extract(line, {Q(diffs.PARENT)}, 1) AS INTEGER) AS s, regexp_extract(line, {Q(diffs.PARENT)}, 2) AS c FROM ls),
q AS (SELECT *, CASE WHEN c = '' THEN 1 ELSE CAST(c AS INTEGER) END AS n FROM p WHERE regexp_matches(line, {Q(diffs.PARENT)}) AND path IS NOT NULL AND path <> '/dev/null')
SELECT scan_id, CAST(pos AS INTEGER) AS pos, path, CASE WHEN n > 0 THEN s ELSE greatest(1, s) END AS first, CASE WHEN n > 0 THEN s + n - 1 ELSE s + 1 END AS last FROM q""")
def diff_parent_hunks(spark, sf_dir):
    return diffs.parent_hunks(S.dealt(spark, sf_dir, "scan_id string, diff string", S.DIFFS, "scan_id"))


@query(f"""WITH {FINDINGS_SQL} SELECT path AS path, count(*) AS findings, string_agg(CASE severity WHEN 'low' THEN 'medium' ELSE severity END || '@' || start_line || ':' || message, ';' ORDER BY start_line, message) AS lines FROM base GROUP BY path""")
def report_rows(spark, sf_dir):
    f = findings.report_form(derived_findings(spark, sf_dir))
    item = F.concat("severity", F.lit("@"), F.col("line").cast("string"), F.lit(":"), "why")
    g = f.groupBy("path").agg(F.count("*").alias("findings"), F.sort_array(F.collect_list(F.struct("line", "why", item.alias("i")))).alias("xs"))
    return g.select("path", "findings", F.array_join(F.transform("xs", lambda x: x["i"]), ";").alias("lines"))


SARIF_RESULT = """'{"ruleId":"' || type || '","level":"' || level || '","message":{"text":"' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || start_line || '}}}],"partialFingerprints":{"primary/v1":"' || type || ':' || path || ':' || start_line || '"}}'"""


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT *, doc_id % 20 AS scan_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM base),
r AS (SELECT scan_id, CAST(count(*) AS INTEGER) AS results, string_agg({SARIF_RESULT}, ',' ORDER BY path, start_line, type, {SARIF_RESULT}) AS body FROM f GROUP BY scan_id),
t AS (SELECT scan_id, string_agg('{{"id":"' || type || '"}}', ',' ORDER BY type) AS rules FROM (SELECT DISTINCT scan_id, type FROM f) GROUP BY scan_id)
SELECT scan_id, results, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"gristmill","rules":[' || rules || ']}}}},"invocations":[{{"executionSuccessful":true}}],"results":[' || body || ']}}]}}' AS sarif FROM r JOIN t USING (scan_id)""")
def sarif_log(spark, sf_dir):
    f = derived_findings(spark, sf_dir).withColumn("scan_id", F.col("doc_id") % 20)
    return sinks.result_log(f, F.lit(False))


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT *, doc_id % 20 AS scan_id, doc_id % 3 = 0 AS introduced FROM base), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, introduced ORDER BY path, start_line, type) AS k FROM f),
l AS (SELECT scan_id, string_agg('- `' || path || ':' || start_line || '` ' || message, chr(10) ORDER BY k) FILTER (introduced AND k <= 10) AS fresh, string_agg('- `' || path || ':' || start_line || '` ' || message, chr(10) ORDER BY k) FILTER (NOT introduced AND k <= 10) AS known, count(*) FILTER (introduced) AS new, count(*) FILTER (NOT introduced) AS old FROM r GROUP BY scan_id)
SELECT scan_id, new, old, '## Scan result' || chr(10) || chr(10) || new || ' new, ' || old || ' pre-existing' || chr(10) || chr(10) || coalesce(fresh, '') || CASE WHEN new > 10 THEN chr(10) || '- …and ' || (new - 10) || ' more' ELSE '' END || chr(10) || chr(10)
 || coalesce(known, '') || CASE WHEN old > 10 THEN chr(10) || '- …and ' || (old - 10) || ' more' ELSE '' END || chr(10) || {Q(sinks.MARKER)} AS comment FROM l""")
def comment_text(spark, sf_dir):
    f = derived_findings(spark, sf_dir).withColumn("scan_id", F.col("doc_id") % 20).withColumn("introduced", F.col("doc_id") % 3 == 0)
    return sinks.comments(f)


@query(f"""WITH {S.DOCUMENT_SNIPPETS_SQL} SELECT path FROM files WHERE lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN ('ts', 'tsx', 'js', 'jsx', 'py', 'go') AND NOT regexp_matches(path, '(^|/)hooks/') AND NOT regexp_matches(path, '\\A(cmd/[^/]*)(/|\\z)')""")
def directory_walk(spark, sf_dir):
    return files.walk(S.document_snippets(spark, sf_dir), ignore_file="# comment\n\nhooks/\n!keep.ts\n/cmd/*\n").select("path")


@query(f"""WITH {S.DOCUMENT_SNIPPETS_SQL}, p AS (SELECT path, 'part of ' || path AS content, length(path) % 3 <> 0 AS has_added FROM files), h AS (SELECT path, CASE WHEN length(path) % 5 = 0 THEN NULL ELSE content END AS content, CASE WHEN length(path) % 5 = 0 THEN 'fetch failed' END AS error FROM files WHERE path NOT LIKE 'app/%')
SELECT p.path, CASE WHEN h.content IS NOT NULL THEN h.content ELSE p.content END AS content, CASE WHEN h.content IS NOT NULL THEN 'whole_file' ELSE 'part' END AS origin, h.error AS input_error FROM p LEFT JOIN h USING (path) WHERE h.content IS NOT NULL OR has_added""")
def whole_file_enrichment(spark, sf_dir):
    f = S.document_snippets(spark, sf_dir)
    parts = f.select("path", F.concat(F.lit("part of "), "path").alias("content"), (F.length("path") % 3 != 0).alias("has_added"))
    bad = F.length("path") % 5 == 0
    head = f.where(~F.col("path").startswith("app/")).select("path", F.when(~bad, F.col("content")).alias("content"), F.when(bad, "fetch failed").alias("error"))
    return files.whole_files(parts, head).select("path", "content", "origin", "input_error")


@query("""SELECT id, valid, rule, start_line FROM (VALUES (1, true, 'r1', 3), (1, true, 'r2', 9), (2, true, NULL, NULL), (3, false, NULL, NULL)) t(id, valid, rule, start_line)""")
def scanner_payloads(spark, sf_dir):
    rows = [(1, '{"results":[{"check_id":"r1","start":{"line":3}},{"check_id":"r2","start":{"line":9}}]}'), (2, '{"findings":[]}'), (3, "not json")]
    return readers.scanner_results(S.inline(spark, "id int, json string", rows)).select("id", "valid", "rule", "start_line")


