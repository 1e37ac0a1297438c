"""Queries over reviews, recordings, settings and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import findings, review
from gristmill.plans import stand_ins as S
from gristmill.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
Q = S.sql_literal
query = S.registrar(QUERIES, ORACLE_SQL)


ROUTE_FILE = "x\nrouter.get('/users/:id', h)\nrouter.post('/users/:id/', h)\napp.route('/users')\napi.get('/api/users/:id', h)\napp.all('/', z)\n"
ANCHORS = [(1, "GET /users/:id", 9), (2, "POST /users/:id?x=1", 9), (3, "/api/users/:id", 9), (4, "DELETE /v1/users", 9), (5, "nothing", 9), (6, "PUT /zzz", 7), (7, None, 3), (8, "/", 9)]
BARE = "CASE WHEN length(regexp_replace({0}, '[?#].*$', '')) > 1 THEN regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '') ELSE regexp_replace({0}, '[?#].*$', '') END"


@query(f"""WITH {S.values('a', 'id, route, fallback', ANCHORS)}, w AS (SELECT id, fallback, lower(regexp_extract(trim(route), '^([A-Za-z]+)\\s+(/\\S*)$', 1)) AS m,
 {BARE.format("CASE WHEN regexp_matches(trim(route), '^([A-Za-z]+)\\s+(/\\S*)$') THEN regexp_extract(trim(route), '^([A-Za-z]+)\\s+(/\\S*)$', 2) WHEN starts_with(trim(route), '/') THEN regexp_extract(trim(route), '^(\\S+)', 1) END")} AS p FROM a),
l AS (SELECT unnest(string_split({Q(ROUTE_FILE)}, chr(10))) AS t, unnest(generate_series(1, 7)) AS n), d AS (SELECT n, lower(regexp_extract(t, {Q(review.ROUTE_LINE)}, 1)) AS v, {BARE.format("regexp_extract(t, " + Q(review.ROUTE_LINE) + ", 2)")} AS o FROM l WHERE regexp_matches(t, {Q(review.ROUTE_LINE)})),
s AS (SELECT id, n, CASE WHEN o = p THEN 10000 WHEN o <> '' AND ends_with(p, o) THEN length(o) WHEN o <> '' AND ends_with(o, p) THEN length(p) END AS score FROM w, d WHERE p IS NOT NULL AND (o = '' OR starts_with(o, '/')) AND (m = '' OR v IN ('route', 'all') OR v = m)),
b AS (SELECT id, arg_max(n, score * 100 - n) AS line FROM s WHERE score IS NOT NULL GROUP BY id) SELECT w.id, CAST(coalesce(line, fallback) AS INTEGER) AS line FROM w LEFT JOIN b USING (id)""")
def route_anchor(spark, sf_dir):
    asked = S.inline(spark, "id int, route string, fallback int", ANCHORS).withColumn("content", F.lit(ROUTE_FILE))
    return review.route_anchor(asked).select("id", "line")


NAMES = ["requireUser", "isAdmin", "canEdit", "scan", "roleGuard", "jwtCheck", "policy", "x"]


@query(f"WITH {S.dealt_sql('n', 'name', NAMES)} SELECT doc_id, name, CASE WHEN regexp_matches(name, {Q(review.GUARD_AUTH)}) THEN 'auth' WHEN regexp_matches(name, {Q(review.GUARD_ROLE)}) OR regexp_matches(name, {Q(review.GUARD_CAN)}) THEN 'role' ELSE 'other' END AS kind FROM n")
def guard_kinds(spark, sf_dir):
    return S.dealt(spark, sf_dir, "name string", NAMES).select("doc_id", "name", review.guard_kind(F.col("name")).alias("kind"))


PATHS = ["docs/a.ts", "src/README.md", "src/tests/a.ts", "a.spec.ts", "e2e/x.ts", "demo/x.ts", "x.sample.js", "sample.ts", ".env.example", "a\\docs\\x.ts", "src/a.ts", "config/env.template"]


@query(f"""WITH {S.dealt_sql('f', 'path', PATHS)}, p AS (SELECT doc_id, path, lower(replace(path, '\\', '/')) AS p FROM f)
SELECT doc_id, path, CASE WHEN regexp_matches(p, '(?:^|/)(?:docs?|documentation)/') OR regexp_matches(regexp_extract(p, '([^/]*)$', 1), '\\b(?:readme|changelog)\\b') THEN 'docs'
 WHEN regexp_matches(p, '(?:^|/)(?:test|tests|__tests__|spec|specs|e2e)/') OR regexp_matches(p, '\\.(?:test|spec)\\.[a-z]+$') THEN 'tests'
 WHEN regexp_matches(p, '(?:^|/)(?:examples?|samples?|demo|demos|fixtures?)/') OR regexp_matches(regexp_extract(p, '([^/]*)$', 1), '\\b(?:example|sample)\\.[a-z]+$') THEN 'examples'
 WHEN regexp_matches(p, '\\.(?:env|env\\.example|env\\.sample)$') OR regexp_matches(p, '\\b(?:\\.env|env)\\.(?:example|sample|template)') THEN 'config-samples' ELSE 'source' END AS category FROM p""")
def path_categories(spark, sf_dir):
    return S.dealt(spark, sf_dir, "path string", PATHS).select("doc_id", "path", review.path_category(F.col("path")).alias("category"))


@query("""WITH d AS (SELECT doc_id % 50 AS thread, doc_id AS id, text FROM documents) SELECT thread, max(id) AS id FROM d WHERE contains(text, 'the') AND id % 3 <> 0 GROUP BY thread""")
def latest_marked_comment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("thread"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return review.latest_marked(d, "the", F.col("id") % 3 != 0)


RECORDED = [
    ("a", "1", '{"verdicts":[{"isVulnerable":true,"confidence":"MEDIUM"},{"isVulnerable":false,"confidence":"medium"},{"confidence":"high"}]}'), ("a", "2", '{"isVulnerable":true,"confidence":"high"}'), ("a", "3", "{}"), ("b", "4", "nope"), ("b", "5", '{"isVulnerable":false,"confidence":"medium"}'),
]


@query("SELECT * FROM (VALUES ('a', 3, 1, 3, 1, 1), ('b', 2, 1, 1, 0, 1)) t(corpus, recordings, unparseable, verdicts, medium_yes, medium_no)")
def recorded_medium_census(spark, sf_dir):
    return review.medium_census(S.inline(spark, "corpus string, file string, input string", RECORDED))


SETTINGS = [(1, "low", [" a ", "", "b"], None), (2, "severe", ["x" * 201], ["idor", "idor"]), (3, None, [], ["nope", "idor"]), (4, "high", [f"g{i}" for i in range(101)], [])]


@query("""SELECT * FROM (VALUES (1, 2, -1, ''), (2, 1, 1, 'severity; glob too long'), (3, 0, 2, 'severity; unknown detector id: nope'), (4, 101, 0, 'too many globs')) t(tenant, globs, enabled, errors)""")
def settings_validation(spark, sf_dir):
    s = review.settings_errors(S.inline(spark, "tenant int, severity string, globs array<string>, enabled array<string>", SETTINGS), list(findings.DETECTORS.values()))
    return s.select("tenant", F.size("globs").alias("globs"), F.coalesce(F.when(F.col("enabled").isNotNull(), F.size("enabled")), F.lit(-1)).alias("enabled"), "errors")


SCREEN_SQL = ", ".join(f"count(*) FILTER (starts_with(line, {Q(sign)}) AND regexp_matches(line, {Q(rx)})) AS {n.replace('-', '_')}" for n, (sign, rx) in review.PRESCREEN.items())
NAMES_SQL = ", ".join(f"CASE WHEN changed > 600 THEN 0 ELSE {n.replace('-', '_')} END AS {n.replace('-', '_')}" for n in review.PRESCREEN)


@query(f"""WITH d AS (SELECT doc_id % 20 AS c, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END || CASE doc_id % 4 WHEN 0 THEN ' verify role' WHEN 1 THEN ' token = "' || left(sha256(CAST(doc_id AS VARCHAR)), 20) || '"' WHEN 2 THEN ' guard' ELSE ' log(process.env)' END AS line FROM documents),
g AS (SELECT c AS "commit", count(*) AS changed, {SCREEN_SQL} FROM d GROUP BY c) SELECT "commit", changed, changed > 600 AS too_large, {NAMES_SQL} FROM g""")
def sign_aware_prescreen(spark, sf_dir):
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, " verify role").when(i % 4 == 1, F.concat(F.lit(' token = "'), F.substring(F.sha2(i.cast("string"), 256), 1, 20), F.lit('"'))).when(i % 4 == 2, " guard").otherwise(" log(process.env)")
    return review.prescreen(table(spark, sf_dir, "documents").select((i % 20).alias("commit"), F.concat(F.when(i % 2 == 0, "+").otherwise("-"), text).alias("line")))


@query("""SELECT doc_id AS review, 1 AS "index", 'IDOR' AS category, 'src/' || doc_id || '.ts' AS path, CAST(n_chars AS INTEGER) AS line, 'High' AS severity, 'missing owner check in ' || lang || ' again' AS description FROM documents
UNION ALL SELECT doc_id, 2, 'access control', 'lib/' || lang || '.py', NULL, 'low', '' FROM documents WHERE doc_id % 3 <> 0""")
def reported_findings(spark, sf_dir):
    """Findings read from a written review of each document; headings that name no finding and what stands below them are left out."""
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    first = F.concat(F.lit("# Report\n## Vuln 1: IDOR: `./src/"), number, F.lit(".ts:"), F.col("n_chars").cast("string"), F.lit("`\n- Severity: High\n- Description: missing owner check in "), "lang", F.lit("\n* Description: again\n"))
    second = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("## Vuln 2: access control: lib/"), "lang", F.lit(".py\n- Severity: low\n"))).otherwise("")
    return review.reported(d.select(F.col("doc_id").alias("review"), F.concat(first, second, F.lit("# Vuln bad\n- Severity: none\n")).alias("markdown")))


@query("""WITH f AS (SELECT doc_id, source || '/' || (doc_id % 9) || '.ts' AS path, CAST(n_chars % 60 AS INTEGER) AS line FROM documents), w AS (SELECT * FROM (VALUES ('1.ts', 5, 20), ('src2/2.ts', 0, 9), ('root/src3/3.ts', 10, 50)) w(path, first, last))
SELECT DISTINCT f.doc_id FROM f, w WHERE (f.path = w.path OR ends_with(f.path, '/' || w.path) OR ends_with(w.path, '/' || f.path)) AND line BETWEEN first AND last""")
def findings_in_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), (F.col("doc_id") % 9).cast("string"), F.lit(".ts")).alias("path"), (F.col("n_chars") % 60).cast("int").alias("line"), F.lit("access").alias("category"), F.lit("").alias("description"))
    w = S.inline(spark, "path string, first int, last int", [("1.ts", 5, 20), ("src2/2.ts", 0, 9), ("root/src3/3.ts", 10, 50)])
    return review.window_hits(d, w, "access").select("doc_id")


@query("""WITH f AS (SELECT DISTINCT doc_id % 7 AS "case", source || '/a' || (doc_id % 5) || '.ts' AS path, CAST(n_chars % 40 AS INTEGER) AS line FROM documents), t AS (SELECT DISTINCT doc_id % 7 AS "case", 'a' || (doc_id % 5) || '.ts' AS path, CAST(n_chars % 40 AS INTEGER) AS line FROM documents WHERE doc_id % 6 = 0)
SELECT f."case", path, line, EXISTS (SELECT 1 FROM t WHERE t."case" = f."case" AND t.line = f.line AND (t.path = f.path OR ends_with(f.path, '/' || t.path))) AS real FROM f""")
def hotspot_truth(spark, sf_dir):
    i, line = F.col("doc_id"), (F.col("n_chars") % 40).cast("int").alias("line")
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("a"), (i % 5).cast("string"), F.lit(".ts"))
    found = d.select((i % 7).alias("case"), F.concat("source", F.lit("/"), name).alias("path"), line).distinct()
    truth = d.where(i % 6 == 0).select((i % 7).alias("case"), name.alias("path"), line, F.lit(True).alias("vulnerable")).distinct()
    return review.hotspots(found, truth)


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob FROM documents")
def blob_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", review.blob_hash(F.col("text")).alias("blob"))


@query()
def request_keys(spark, sf_dir):
    """Keys of requests, two of which differ in the order of their members only."""
    rows = ['{"b":1,"a":{"d":2,"c":[3,{"f":1,"e":2}]}}', '{"a":{"c":[3,{"e":2,"f":1}],"d":2},"b":1}', None]
    return S.dealt(spark, sf_dir, "request string", rows).select("doc_id", "request", review.request_key("request").alias("key"))


@query()
def defect_windows(spark, sf_dir):
    """Windows around an anchor in code that follows each document's text."""
    rows = [("a\nfunction f() {\n  x = '{';\n  if (a) {\n    y();\n  }\n}\nz\n", 5), ("one\ntwo\n", 40)]
    code = S.dealt(spark, sf_dir, "code string, anchor int", rows).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    w = code.select("doc_id", review.defect_window(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "code"), (F.col("anchor") + lines).cast("int")).alias("w"))
    return w.select("doc_id", "w.first", "w.last")
