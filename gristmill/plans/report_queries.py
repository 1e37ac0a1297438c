"""Queries over reports: coverage and its gaps, logs, comments with errors, scanner payloads, findings at the line of their verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import review, scan
from gristmill.plans import composed_queries as C
from gristmill.plans import scan_queries as Q
from gristmill.plans import stand_ins as S
from gristmill.plans.review_queries import BARE
from gristmill.runtime import table
from gristmill.sources import readers, reports, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)

#: Twenty scans of the derived findings. The fifth found nothing, all calls of the seventh failed, and no file of the thirteenth was read.
SCANS_SQL = f"""{Q.FINDINGS_SQL}, res AS (SELECT doc_id, doc_id % 20 AS scan_id, path, 1 + n % 3 AS calls, CASE WHEN doc_id % 20 = 7 THEN 1 + n % 3 WHEN doc_id % 4 = 3 AND doc_id % 23 = 0 THEN 1 ELSE 0 END AS calls_failed,
  CASE WHEN doc_id % 20 = 13 OR (doc_id % 4 = 2 AND doc_id % 31 = 0) THEN 'unreadable' END AS aborted, CASE WHEN doc_id % 4 = 1 AND doc_id % 17 = 0 THEN ['idor', 'admin-check'] WHEN doc_id % 2 = 0 THEN [] END AS detectors_failed FROM (SELECT *, start_line AS n FROM base)),
f AS (SELECT *, doc_id % 20 AS scan_id FROM base WHERE doc_id % 20 <> 5),
c AS (SELECT scan_id, count(*) AS files, count(aborted) AS aborted, sum(calls)::BIGINT AS calls, sum(calls_failed)::BIGINT AS failed, sum(coalesce(len(detectors_failed), 0))::BIGINT AS detectors FROM res GROUP BY scan_id),
cov AS (SELECT *, CASE WHEN aborted + failed + detectors = 0 THEN 'full' WHEN aborted = files OR (failed > 0 AND failed >= calls) THEN 'blind' ELSE 'degraded' END AS status,
  concat_ws('; ', CASE WHEN failed > 0 THEN failed || ' of ' || calls || ' calls failed' END, CASE WHEN aborted > 0 THEN aborted || ' of ' || files || ' files were not analysed' END, CASE WHEN detectors > 0 THEN detectors || ' detector runs failed' END) AS causes FROM c)"""


def scans(spark, sf_dir):
    """(findings, results) of the scans."""
    base, i = Q.derived_findings(spark, sf_dir), F.col("doc_id")
    calls = 1 + F.col("start_line") % 3
    none = F.array().cast("array<string>")
    results = base.select(
        (i % 20).alias("scan_id"), "path", calls.alias("calls"), F.when(i % 20 == 7, calls).when((i % 4 == 3) & (i % 23 == 0), 1).otherwise(0).alias("calls_failed"),
        F.when((i % 20 == 13) | ((i % 4 == 2) & (i % 31 == 0)), "unreadable").alias("aborted"), F.when((i % 4 == 1) & (i % 17 == 0), F.array(F.lit("idor"), F.lit("admin-check"))).when(i % 2 == 0, none).alias("detectors_failed"),
    )
    return base.where(i % 20 != 5).withColumn("scan_id", i % 20), results


@query(f"WITH {SCANS_SQL} SELECT * FROM cov")
def scan_coverage(spark, sf_dir):
    return reports.coverage(scans(spark, sf_dir)[1])


@query(f"""WITH {SCANS_SQL}, gl AS (SELECT scan_id, path, CASE WHEN aborted IS NOT NULL THEN '- `' || path || '`: not analysed, ' || aborted ELSE array_to_string(list_concat(CASE WHEN calls_failed > 0 THEN ['- `' || path || '`: ' || calls_failed || ' failed calls'] ELSE [] END, list_transform(coalesce(detectors_failed, []), lambda d: '- `' || path || '`: detector ' || d || ' failed')), chr(10)) END AS line FROM res),
g AS (SELECT scan_id, string_agg(line, chr(10) ORDER BY path, line) AS gaps FROM gl WHERE line <> '' GROUP BY scan_id),
i AS (SELECT scan_id, path, severity, start_line, type, '- **' || severity || '** `' || type || '` line ' || start_line || ': ' || message AS item FROM f),
p AS (SELECT scan_id, path, '## ' || path || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY start_line, type, item) || chr(10) AS text, count(*) AS n, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in reports.COUNTED)} FROM i GROUP BY scan_id, path),
s AS (SELECT scan_id, string_agg(text, chr(10) ORDER BY path, text) AS parts, count(*) AS hit, sum(n)::BIGINT AS n, {', '.join(f"sum({s})::BIGINT AS {s}" for s in reports.COUNTED)} FROM p GROUP BY scan_id)
SELECT scan_id, status, '# Scan report' || chr(10) || chr(10) || CASE status WHEN 'blind' THEN '> **Blind scan.** It says nothing about these files: ' || causes || '.' || chr(10) || chr(10) WHEN 'degraded' THEN '> **Degraded coverage, not a clean scan.** Files under coverage gaps may hold more: ' || causes || '.' || chr(10) || chr(10) ELSE '' END
 || '- Files: ' || files || chr(10) || '- Files analysed: ' || (files - aborted) || chr(10) || '- Files with findings: ' || coalesce(hit, 0) || chr(10) || '- Findings: ' || coalesce(n, 0) || chr(10) || '- Severity: critical=' || coalesce(critical, 0) || ', high=' || coalesce(high, 0) || ', medium=' || coalesce(medium, 0)
 || chr(10) || '- Coverage: ' || status || ', ' || (calls - failed) || ' of ' || calls || ' calls succeeded' || chr(10) || coalesce(chr(10) || '## Coverage gaps' || chr(10) || chr(10) || gaps || chr(10), '') || coalesce(chr(10) || parts, '') AS markdown FROM cov LEFT JOIN s USING (scan_id) LEFT JOIN g USING (scan_id)""")
def scan_report(spark, sf_dir):
    """One report a scan; blind and degraded ones say so, name every gap, and never look clean."""
    return reports.scan_report(*scans(spark, sf_dir))


@query(f"""WITH {SCANS_SQL}, l AS (SELECT *, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM f),
r AS (SELECT scan_id, CAST(count(*) AS INTEGER) AS results, string_agg({Q.SARIF_RESULT}, ',' ORDER BY path, start_line, type, {Q.SARIF_RESULT}) AS body FROM l GROUP BY scan_id),
t AS (SELECT scan_id, string_agg('{{"id":"' || type || '"}}', ',' ORDER BY type) AS rules FROM (SELECT DISTINCT scan_id, type FROM l) GROUP BY scan_id)
SELECT scan_id, coalesce(results, 0) AS results, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"gristmill","rules":[' || coalesce(rules, '') || ']}}}},"invocations":[{{"executionSuccessful":' || (status = 'full') || CASE WHEN status <> 'full' THEN ',"toolExecutionNotifications":[{{"level":"error","message":{{"text":"Coverage lost: ' || causes || '"}}}}]' ELSE '' END || '}}],"results":[' || coalesce(body, '') || ']}}]}}' AS sarif FROM cov LEFT JOIN r USING (scan_id) LEFT JOIN t USING (scan_id)""")
def sarif_with_coverage(spark, sf_dir):
    """A log for every scan, also of one without findings; a scan that lost coverage did not succeed."""
    found, results = scans(spark, sf_dir)
    return sinks.result_log(found, F.lit(False), coverage=reports.coverage(results))


@query(f"""WITH {Q.FINDINGS_SQL}, f AS (SELECT *, doc_id % 20 AS scan_id, doc_id % 3 = 0 AS introduced FROM base WHERE doc_id % 20 <> 5), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, introduced ORDER BY path, start_line, type) AS k FROM f),
l AS (SELECT scan_id, string_agg('- `' || path || ':' || start_line || '` ' || message, chr(10) ORDER BY k) FILTER (introduced AND k <= 10) AS fresh, string_agg('- `' || path || ':' || start_line || '` ' || message, chr(10) ORDER BY k) FILTER (NOT introduced AND k <= 10) AS known, count(*) FILTER (introduced) AS new, count(*) FILTER (NOT introduced) AS old FROM r GROUP BY scan_id),
e AS (SELECT doc_id % 20 AS scan_id, doc_id AS place, 'call ' || doc_id || ' failed' AS message FROM documents WHERE doc_id % 20 IN (1, 5) AND doc_id % 3 = 0), x AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY place) AS k, count(*) OVER (PARTITION BY scan_id) AS n FROM e),
m AS (SELECT scan_id, '### Errors' || chr(10) || chr(10) || string_agg('- **' || message || '**', chr(10) ORDER BY k) FILTER (k <= 5) || CASE WHEN any_value(n) > 5 THEN chr(10) || '- …and ' || (any_value(n) - 5) || ' more' ELSE '' END || chr(10) || chr(10) AS errors FROM x GROUP BY scan_id)
SELECT scan_id, coalesce(new, 0) AS new, coalesce(old, 0) AS old, '## Scan result' || chr(10) || chr(10) || coalesce(errors, '') || coalesce(new, 0) || ' new, ' || coalesce(old, 0) || ' pre-existing' || chr(10) || chr(10) || coalesce(fresh, '') || CASE WHEN new > 10 THEN chr(10) || '- …and ' || (new - 10) || ' more' ELSE '' END || chr(10) || chr(10)
 || coalesce(known, '') || CASE WHEN old > 10 THEN chr(10) || '- …and ' || (old - 10) || ' more' ELSE '' END || chr(10) || {Q.Q(sinks.MARKER)} AS comment FROM l FULL JOIN m USING (scan_id)""")
def comment_with_errors(spark, sf_dir):
    i = F.col("doc_id")
    found = Q.derived_findings(spark, sf_dir).where(i % 20 != 5).withColumns({"scan_id": i % 20, "introduced": i % 3 == 0})
    errors = table(spark, sf_dir, "documents").where((i % 20).isin(1, 5) & (i % 3 == 0)).select((i % 20).alias("scan_id"), i.alias("place"), F.concat(F.lit("call "), i.cast("string"), F.lit(" failed")).alias("message"))
    return sinks.comments(found, errors)


@query("""SELECT doc_id AS id, doc_id % 4 <> 3 AS valid, unnest(CASE doc_id % 4 WHEN 0 THEN ['r1', coalesce(lang, 'none')] WHEN 1 THEN [coalesce(source, 'none')] ELSE [NULL] END) AS rule, CAST(unnest(CASE doc_id % 4 WHEN 0 THEN [3, n_chars] WHEN 1 THEN [n_chars + 1] ELSE [NULL] END) AS INTEGER) AS start_line, unnest(CASE doc_id % 4 WHEN 0 THEN [NULL, 'd' || doc_id] WHEN 1 THEN ['d' || doc_id] ELSE [NULL] END) AS path FROM documents""")
def scanner_payload_items(spark, sf_dir):
    """Payloads of a scanner, one a document: results, findings, neither, or no JSON."""
    d = table(spark, sf_dir, "documents")
    item = lambda rule, line, path: F.struct(rule.alias("check_id"), path.alias("path"), F.struct(line.cast("int").alias("line")).alias("start"))
    path, kind = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("doc_id") % 4
    two = F.to_json(F.struct(F.array(item(F.lit("r1"), F.lit(3), F.lit(None).cast("string")), item(F.coalesce("lang", F.lit("none")), F.col("n_chars"), path)).alias("results")))
    one = F.to_json(F.struct(F.array(item(F.coalesce("source", F.lit("none")), F.col("n_chars") + 1, path)).alias("findings")))
    payloads = d.select(F.col("doc_id").alias("id"), F.when(kind == 0, two).when(kind == 1, one).when(kind == 2, '{"findings":[]}').otherwise("not json").alias("json"))
    return readers.scanner_results(payloads).select("id", "valid", "rule", "start_line", "path")


#: Routes that recorded verdicts speak of; the last is no route.
ROUTES = ["GET /users/:id", "POST /api/webhook?x=1", "/debug", "somewhere"]
NUMBER = "string_split(path, '/')[1]::BIGINT"


@query(f"""WITH {C.WIDE_SQL}, a AS (SELECT path, content, [{', '.join(map(Q.Q, ROUTES))}][{NUMBER} // 20 % 4 + 1] AS route, CAST({NUMBER} % 3 + 1 AS INTEGER) AS fallback FROM files),
w AS (SELECT path, lower(regexp_extract(route, '^([A-Za-z]+)\\s+(/\\S*)$', 1)) AS m, {BARE.format("CASE WHEN regexp_matches(route, '^([A-Za-z]+)\\s+(/\\S*)$') THEN regexp_extract(route, '^([A-Za-z]+)\\s+(/\\S*)$', 2) WHEN starts_with(route, '/') THEN regexp_extract(route, '^(\\S+)', 1) END")} AS p FROM a),
l AS (SELECT path, unnest(ls) AS t, unnest(generate_series(1, len(ls))) AS n FROM (SELECT path, string_split_regex(content, '\\r?\\n') AS ls FROM a)), d AS (SELECT path, n, lower(regexp_extract(t, {Q.Q(review.ROUTE_LINE)}, 1)) AS v, {BARE.format("regexp_extract(t, " + Q.Q(review.ROUTE_LINE) + ", 2)")} AS o FROM l WHERE regexp_matches(t, {Q.Q(review.ROUTE_LINE)})),
s AS (SELECT path, n, CASE WHEN o = p THEN 10000 WHEN o <> '' AND ends_with(p, o) THEN length(o) WHEN o <> '' AND ends_with(o, p) THEN length(p) END AS score FROM w JOIN d USING (path) WHERE p IS NOT NULL AND (o = '' OR starts_with(o, '/')) AND (m = '' OR v IN ('route', 'all') OR v = m)),
b AS (SELECT path, arg_max(n, score * 10000000 - n) AS line FROM s WHERE score IS NOT NULL GROUP BY path), r AS (SELECT path, route, content, coalesce(line, fallback) AS line FROM a LEFT JOIN b USING (path)),
k AS (SELECT path, route, CAST(line AS INTEGER) AS start_line, regexp_replace(array_to_string(string_split_regex(content, '\\r?\\n')[line:], chr(10)), '\\A(?:[ \\t]*\\n)+', '') AS rest FROM r)
SELECT path, 'auth_bypass_risk' AS type, route, start_line, array_to_string(string_split(rest, chr(10))[1:10], chr(10)) AS code FROM k""")
def anchored_findings(spark, sf_dir):
    """A finding a document's file, at the route that its verdict names, with the code there."""
    files = C.wide_files(spark, sf_dir)
    number = F.split("path", "/")[0].cast("long")
    route = F.element_at(F.array(*map(F.lit, ROUTES)), (F.floor(number / 20) % 4 + 1).cast("int"))
    found = files.select("path", F.lit("auth_bypass_risk").alias("type"), (number % 3 + 1).cast("int").alias("start_line"), route.alias("route"))
    return scan.reported(found, files).select("path", "type", "route", "start_line", "code")


@query(f"""WITH {Q.FINDINGS_SQL} SELECT tenant, count(*) AS fixes, CAST(0 AS BIGINT) AS high_quality, CAST(0 AS BIGINT) AS medium_quality, count(*) AS low_quality, CAST(0 AS BIGINT) AS errors, count(*) AS unchanged, count(*) FILTER (doc_id % 3 = 0) AS defaulted FROM base WHERE type = 'env_exposure_risk' GROUP BY tenant""")
def unpatched_findings(spark, sf_dir):
    """Fixes that leave the code as it is, counted like any other, and how many took the default explanation."""
    found = Q.derived_findings(spark, sf_dir).where("type = 'env_exposure_risk'")
    given = F.when(F.col("doc_id") % 3 != 0, F.col("message")).when(F.col("doc_id") % 2 == 0, " ")
    fixes = scan.unpatched(found.withColumns({"code": F.col("message"), "explanation": given}))
    same = fixes.groupBy("tenant").agg(F.count_if(F.col("fixed_code") == F.col("code")).alias("unchanged"), F.count_if(F.col("explanation") != F.col("message")).alias("defaulted"))
    return scan.patch_counts(fixes, ["tenant"]).join(same, "tenant")
