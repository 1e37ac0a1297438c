"""Queries over whole scans: all detectors on files, united findings, coverage and patch counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.catalog import REDACTED, patterns
from gristmill.functions.text import backoff_ms
from gristmill.operators import experiments, findings, matching, pairing, routes, scan
from gristmill.plans import scan_queries as Q
from gristmill.plans import stand_ins as S
from gristmill.runtime import cut, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)

ROUTE = "(pattern_id LIKE '%\\_route\\_def' ESCAPE '\\' OR pattern_id LIKE '%\\_handler\\_def' ESCAPE '\\')"
EARLY = {f: patterns(f) for f in ("webhook-unverified", "env-exposure", "admin-check")}
IDS = S.values("ids", "role, ord, pattern_id", [(p.role, p.ord, p.id) for p in Q.IDOR])


def asked_sql(files: str) -> str:
    """asked(path, family, pair_index, line, pattern_id, rule_id, tier, route) over the table expression `files`."""
    early = " UNION ALL ".join(f"SELECT {S.sql_literal(f)} AS family, * FROM (WITH {Q.earliest_sql(ps)}, {Q.names_sql(ps)} SELECT path, pattern_id, tier, {Q.LINE_OF} AS line FROM hits JOIN names USING (ord))" for f, ps in EARLY.items())
    auth = f"SELECT path, line, pattern_id, row_number() OVER (PARTITION BY path ORDER BY NOT (pattern_id LIKE '%route_def' OR pattern_id LIKE '%handler_def'), line, ord) AS r FROM (WITH {Q.LINES_SQL}, {Q.FIRST_SQL}, {Q.names_sql(Q.AUTH)} SELECT path, line, ord, pattern_id FROM first JOIN names USING (ord))"
    secret = f"SELECT path, arg_min(line, pos * 1000 + ord) AS line, arg_min(pattern_id, pos * 1000 + ord) AS pattern_id FROM (WITH {Q.every_match_sql(Q.SECRETS)} SELECT * FROM matches) WHERE NOT regexp_matches(match, {S.sql_literal(REDACTED)}) GROUP BY path"
    pairs = f"SELECT path, pair_index, sink_line AS line, a.pattern_id AS source_id, b.pattern_id AS sink_id FROM (WITH {Q.every_match_sql(Q.IDOR)}, {Q.PAIRS_SQL.format(hits='matches')} SELECT * FROM ranked WHERE pair_index < 12) JOIN ids a ON a.role = 'source' AND a.ord = source_k // 1000000000 JOIN ids b ON b.role = 'sink' AND b.ord = sink_k // 1000000000"
    return f"""{files}, {IDS}, asked AS (SELECT path, family, 0 AS pair_index, line, pattern_id, family || '-' || pattern_id AS rule_id, tier, {ROUTE} AS route FROM ({early})
UNION ALL SELECT path, 'auth-bypass', 0, line, pattern_id, 'auth-bypass-' || pattern_id, 'judgment', {ROUTE} FROM ({auth}) WHERE r = 1
UNION ALL SELECT path, 'secrets-exposure', 0, line, pattern_id, 'secrets-exposure-' || pattern_id, 'literal', false FROM ({secret})
UNION ALL SELECT path, 'idor', pair_index, line, sink_id, 'idor-' || source_id || '-' || sink_id, 'judgment', false FROM ({pairs}))"""


#: Recorded verdicts follow from path, line and pair by the same rule in Spark and SQL; every seventh is missing.
VERDICT_SQL = """v AS (SELECT *, length(path) + line + pair_index AS k, length(path) + pair_index AS j FROM asked),
w AS (SELECT *, j % 7 <> 0 AS judged, k % 5 <> 0 AS vulnerable, ['high', 'MEDIUM', 'low', 'high'][k % 4 + 1] AS conf, CASE j % 3 WHEN 0 THEN 'authenticated' WHEN 1 THEN 'unauthenticated' ELSE 'unclear' END AS caller,
  CASE k % 3 WHEN 0 THEN 'administrative' ELSE 'ordinary' END AS op, CASE k % 2 WHEN 0 THEN 'promote' ELSE 'drop' END AS second FROM v),
o AS (SELECT *, tier = 'literal' AND family IN ('secrets-exposure', 'admin-check') AS bypassed, CASE WHEN tier = 'literal' AND family IN ('secrets-exposure', 'admin-check') THEN 'emitted' WHEN NOT judged THEN 'unjudged' WHEN NOT vulnerable THEN 'safe' WHEN conf = 'low' THEN 'low'
  WHEN (family = 'idor' AND (caller = 'unauthenticated' OR op = 'administrative')) OR (family = 'auth-bypass' AND route AND caller = 'authenticated' AND op = 'administrative') THEN 'deferred'
  WHEN conf = 'MEDIUM' THEN {medium} ELSE 'emitted' END AS outcome FROM w)"""
PLAIN, ESCALATED = VERDICT_SQL.format(medium="'review-queue'"), VERDICT_SQL.format(medium="CASE second WHEN 'promote' THEN 'emitted' ELSE 'safe' END")
PLACE = "CASE family " + " ".join(f"WHEN '{d.family}' THEN {i}" for i, d in enumerate(scan.REGISTRY)) + " END"
TYPE = "CASE family " + " ".join(f"WHEN '{d.family}' THEN '{d.type}'" for d in scan.REGISTRY) + " END"
#: Every document as a file: its text, then one of the snippets; the path is the snippet's below the document's number.
WIDE_SQL = f"""{S.values('snip', 'path, content', S.SNIPPETS)}, n AS (SELECT *, row_number() OVER () - 1 AS i FROM snip),
files AS (SELECT doc_id || '/' || path AS path, text || chr(10) || content AS content FROM documents JOIN n ON doc_id % {len(S.SNIPPETS)} = i)"""


def wide_files(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    paths, contents = (F.element_at(F.array(*(F.lit(x[i]) for x in S.SNIPPETS)), (F.col("doc_id") % len(S.SNIPPETS) + 1).cast("int")) for i in (0, 1))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), paths).alias("path"), F.concat("text", F.lit("\n"), contents).alias("content"))


def recorded(asked):
    """Verdicts by the rule of `VERDICT_SQL`."""
    k, j = F.length("path") + F.col("line") + F.col("pair_index"), F.length("path") + F.col("pair_index")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    return asked.where(j % 7 != 0).select(
        "path", "family", "pair_index", F.lit(0).alias("place"), (k % 5 != 0).alias("is_vulnerable"), pick(["high", "MEDIUM", "low", "high"], k % 4).alias("confidence"),
        pick(["authenticated", "unauthenticated", "unclear"], j % 3).alias("caller_auth"), pick(["administrative", "ordinary", "ordinary"], k % 3).alias("operation_class"), pick(["promote", "drop"], k % 2).alias("second"),
    )


def _judged(files, escalate=False):
    rows = cut(scan.asked(files))  # the contents are searched once for the hits and for their verdicts
    return scan.judged(rows, recorded(rows), escalate=escalate)


@query(f"WITH {asked_sql(S.DOCUMENT_SNIPPETS_SQL)}, {PLAIN} SELECT path, family, CAST(pair_index AS INTEGER) AS pair_index, CAST(line AS INTEGER) AS line, rule_id, bypassed, outcome FROM o")
def scan_outcomes_judged(spark, sf_dir):
    """What each detector asks about the snippets, and what becomes of it; the literal tier needs no verdict."""
    return _judged(S.document_snippets(spark, sf_dir)).select("path", "family", "pair_index", "line", "rule_id", "bypassed", "outcome")


@query(f"WITH {asked_sql(S.DOCUMENT_SNIPPETS_SQL)}, {ESCALATED} SELECT family, outcome, count(*) AS n FROM o GROUP BY ALL")
def escalated_outcomes(spark, sf_dir):
    """With escalation a second look decides on medium confidence."""
    return _judged(S.document_snippets(spark, sf_dir), escalate=True).groupBy("family", "outcome").agg(F.count("*").alias("n"))


#: Findings over the document files, gated by tenant settings, united in registry order, then split by changed lines.
UNITED_SQL = f"""{asked_sql(WIDE_SQL)}, {PLAIN}, f AS (SELECT {PLACE} AS place, family AS detector, {TYPE} AS type, path, CAST(line AS INTEGER) AS start_line, rule_id, CASE WHEN bypassed THEN 'high' ELSE lower(conf) END AS confidence, pair_index, length(path) % 5 AS tenant FROM o WHERE outcome = 'emitted'),
{S.values('settings', 'tenant, threshold, globs, enabled', Q.SETTINGS)},
j AS (SELECT f.*, enabled, globs, list_filter(enabled::VARCHAR[], lambda x: x IN ({', '.join(map(S.sql_literal, findings.DETECTORS.values()))})) AS known FROM f LEFT JOIN settings USING (tenant)),
kept AS (SELECT * FROM j WHERE len(list_filter(globs, lambda g: regexp_matches(path, g))) = 0 AND NOT (enabled IS NOT NULL AND (len(enabled) = 0 OR (len(known) > 0 AND NOT list_contains(known, detector))))),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, start_line, type ORDER BY place, pair_index, rule_id) AS r FROM kept) WHERE r = 1),
final AS (SELECT place, detector, type, path, start_line, rule_id, confidence, tenant, CASE WHEN length(path) % 3 = 0 THEN true ELSE 40 BETWEEN start_line - 5 AND start_line + 40 END AS introduced FROM u)"""


def _united(spark, sf_dir):
    found = scan.emitted(_judged(wide_files(spark, sf_dir))).withColumn("tenant", F.length("path") % 5)
    settings = S.inline(spark, "tenant int, threshold string, globs array<string>, enabled array<string>", Q.SETTINGS)
    kept = findings.tenant_filter(found, settings).where("drop_reason IS NULL")
    files = wide_files(spark, sf_dir).select("path").where(F.length("path") % 3 != 0)
    changed = files.withColumn("changed", F.array(F.lit(40)))
    return findings.partition_by_change(scan.united(kept), changed, ["path"])


@query(f"WITH {UNITED_SQL} SELECT * FROM final")
def composed_scan(spark, sf_dir):
    """Files to findings over all documents: matches, pairs, verdicts, lanes, settings, registry order, first wins, changed lines."""
    return _united(spark, sf_dir).select("place", "detector", "type", "path", "start_line", "rule_id", "confidence", "tenant", "introduced")


@query(f"WITH {UNITED_SQL}, per AS (SELECT tenant, detector, count(*) AS c FROM final GROUP BY ALL) SELECT tenant, string_agg(detector || ':' || c, ',' ORDER BY detector) AS families, CAST(sum(c) AS BIGINT) AS total FROM per GROUP BY tenant")
def findings_per_detector(spark, sf_dir):
    g = findings.per_family(_united(spark, sf_dir), ["tenant"])
    return g.select("tenant", F.array_join(F.transform(F.array_sort(F.map_entries("families")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("families"), "total")


#: Every document as a file of one of 43 repositories; some could not be read.
REACHED_SQL = f"""{WIDE_SQL.replace('files AS', 'whole AS')}, files AS (SELECT path, CASE WHEN string_split(path, '/')[1]::BIGINT % 17 <> 3 THEN content END AS content, string_split(path, '/')[1]::BIGINT % 43 AS repo FROM whole),
{Q.every_match_sql(Q.IDOR)}, {Q.PAIRS_SQL.format(hits='matches')}, {IDS}, real AS (SELECT path, pattern_id AS source_id FROM ranked JOIN ids ON ids.role = 'source' AND ids.ord = source_k // 1000000000 WHERE pair_index = 0),
guess AS (SELECT DISTINCT path FROM matches a JOIN matches b USING (path) WHERE a.role = 'source' AND b.role = 'sink' AND abs(a.line - b.line) <= 200),
outcomes AS (SELECT repo, path, CASE WHEN content IS NULL THEN 'unreadable' END AS error, CASE WHEN content IS NULL THEN 'failed' WHEN source_id IS NOT NULL AND guess.path IS NOT NULL THEN 'both' WHEN source_id IS NOT NULL THEN 'real only' WHEN guess.path IS NOT NULL THEN 'predicted only' ELSE 'none' END AS outcome, source_id FROM files LEFT JOIN real USING (path) LEFT JOIN guess USING (path))"""


def _reached(spark, sf_dir):
    """The hits are stored once: pairs, their second reading and the files read no text again."""
    number = F.split("path", "/")[0].cast("long")
    files = wide_files(spark, sf_dir).withColumns({"content": F.when(number % 17 != 3, F.col("content")), "repo": number % 43})
    hits = cut(matching.all_hits(files, Q.IDOR).select("path", "role", "pattern_id", "ord", "pos", "line"))
    named = files.select("repo", "path", F.when(F.col("content").isNull(), "unreadable").alias("error"))
    return experiments.reach_outcomes(named, hits, pairing.nearest_pairs(hits), pairing.NEAR_LINES)


@query(f"WITH {REACHED_SQL} SELECT * FROM outcomes")
def reach_outcomes(spark, sf_dir):
    """Every file: read or not, and what two independent pairings say of it."""
    return _reached(spark, sf_dir)


@query(f"""WITH {REACHED_SQL}, r AS (SELECT repo, count(*) AS files, count(*) FILTER (source_id IS NOT NULL AND error IS NULL) AS hit, count(error) AS failed, count(*) FILTER (outcome LIKE '% only') AS odd FROM outcomes GROUP BY repo),
g AS (SELECT count(*) AS repos, sum(files)::BIGINT AS files, count(*) FILTER (hit > 0) AS hit_repos, sum(hit)::BIGINT AS hit_files, sum(failed)::BIGINT AS failed, sum(odd)::BIGINT AS disagreements, 1.959963984540054::DOUBLE AS z FROM r)
SELECT repos, files, hit_repos, hit_files, failed, disagreements, disagreements = 0 AS agreed,
 round(greatest(0, (hit_repos / repos + z * z / (2 * repos) - z * sqrt(hit_repos / repos * (1 - hit_repos / repos) / repos + z * z / (4 * repos * repos))) / (1 + z * z / repos)), 6) AS low,
 round(least(1, (hit_repos / repos + z * z / (2 * repos) + z * sqrt(hit_repos / repos * (1 - hit_repos / repos) / repos + z * z / (4 * repos * repos))) / (1 + z * z / repos)), 6) AS high FROM g""")
def reach_totals(spark, sf_dir):
    return experiments.reach_totals(_reached(spark, sf_dir))


@query(f"""WITH {Q.FINDINGS_SQL}, s AS (SELECT doc_id, path, start_line, type, 0 AS o FROM base WHERE doc_id % 3 <> 0), d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN path ELSE 'diff/' || path END AS path, start_line, type, 1 AS o FROM base WHERE doc_id % 3 <> 2),
u AS (SELECT *, row_number() OVER (PARTITION BY path, start_line, type ORDER BY o) AS r FROM (SELECT * FROM s UNION ALL SELECT * FROM d)) SELECT doc_id, path, start_line, type, CASE o WHEN 0 THEN 'scanner' ELSE 'diff' END AS origin FROM u WHERE r = 1""")
def scanner_and_diff_union(spark, sf_dir):
    f = Q.derived_findings(spark, sf_dir).select("doc_id", "path", "start_line", "type")
    scanned, in_diff = f.where("doc_id % 3 <> 0"), f.where("doc_id % 3 <> 2").withColumn("path", F.when(F.col("doc_id") % 3 == 1, F.col("path")).otherwise(F.concat(F.lit("diff/"), "path")))
    return scan.with_scanner(scanned, in_diff, ["path", "start_line", "type"]).select("doc_id", "path", "start_line", "type", "origin")


@query(f"WITH {Q.FINDINGS_SQL} SELECT type, count(*) AS skipped FROM base WHERE type IN ({', '.join(map(S.sql_literal, findings.SUPPRESSED))}) GROUP BY type")
def unhandled_types(spark, sf_dir):
    """Findings of types without a detector, counted by type."""
    return scan.routed(Q.derived_findings(spark, sf_dir))[1]


@query("""WITH r AS (SELECT source, doc_id % 7 = 0 AS aborted, CASE WHEN doc_id % 5 = 0 THEN doc_id % 3 ELSE 0 END AS calls, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS det FROM documents)
SELECT source, CAST(sum(calls) + count(*) FILTER (aborted) + sum(det) AS BIGINT) AS degradations, count(*) FILTER (calls > 0 OR aborted OR det > 0) AS files_with_gaps, count(*) AS files FROM r GROUP BY source""")
def coverage_degradations(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", (d % 7 == 0).alias("aborted"), F.when(d % 5 == 0, d % 3).otherwise(0).alias("calls_failed"), F.when(d % 11 == 0, 1).otherwise(0).alias("detectors_failed"))
    return scan.coverage_gaps(rows, ["source"])


@query("""WITH f AS (SELECT source, ['high', 'medium', 'low', NULL][doc_id % 4 + 1] AS quality, CASE WHEN doc_id % 9 = 0 THEN 'no patch' END AS error FROM documents)
SELECT source, count(*) FILTER (error IS NULL) AS fixes, count(*) FILTER (error IS NULL AND quality = 'high') AS high_quality, count(*) FILTER (error IS NULL AND quality = 'medium') AS medium_quality, count(*) FILTER (error IS NULL AND coalesce(quality, 'low') = 'low') AS low_quality, count(*) FILTER (error IS NOT NULL) AS errors FROM f GROUP BY source""")
def patch_quality_counts(spark, sf_dir):
    d = F.col("doc_id")
    quality = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (d % 4 + 1).cast("int"))
    return scan.patch_counts(table(spark, sf_dir, "documents").select("source", quality.alias("quality"), F.when(d % 9 == 0, "no patch").alias("error")), ["source"])


ROUTES = [p for p in patterns("auth-bypass") if p.id.endswith(("_route_def", "_handler_def"))]


@query(f"WITH {WIDE_SQL} SELECT regexp_extract(path, '\\.([^.]*)$', 1) AS ending, count(*) AS files, count(*) FILTER ({' OR '.join(f'({Q.admitted(p)} AND regexp_matches(content, {S.sql_literal(p.regex)}))' for p in ROUTES)}) AS with_route FROM files GROUP BY ALL")
def route_shape_census(spark, sf_dir):
    """Files that declare a route of any shape, by file ending."""
    f = wide_files(spark, sf_dir)
    return f.groupBy(F.regexp_extract("path", r"\.([^.]*)$", 1).alias("ending")).agg(F.count("*").alias("files"), F.count_if(matching.route_shape(F.col("path"), F.col("content"), ROUTES)).alias("with_route"))


@query("""SELECT count(*) AS files, count(*) FILTER (doc_id % 9 <> 0) AS parsed, count(*) FILTER (doc_id % 2 = 0) AS routes, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 4 = 0) AS no_guard, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 0) AS no_data_access FROM documents""")
def route_digest(spark, sf_dir):
    """Even documents stand for routes, with as many guards and data accesses as their numbers' remainders."""
    d = table(spark, sf_dir, "documents")
    f = d.select((F.col("doc_id") % 9 != 0).alias("parsed"))
    return routes.digest(f, d.where("doc_id % 2 = 0").select((F.col("doc_id") % 4).alias("guards"), (F.col("doc_id") % 3).alias("data_accesses")))


@query("SELECT event_id, CAST(least(30000, 1000 * power(2, least(greatest(event_id % 9 - 1, 0), 40))) AS BIGINT) AS wait_ms FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", backoff_ms(F.col("event_id") % 9 - 1).alias("wait_ms"))
