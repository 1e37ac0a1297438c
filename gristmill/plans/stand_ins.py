"""Stand-ins for the inputs of a scan, built alike in Spark and in SQL: snippets, verdicts, settings, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.runtime import spread, table

#: Our own code snippets: path, content.
SNIPPETS = [
    ("src/server.ts", 'import express from "express";\nconst app = express();\napp.get("/users/:id", async (req, res) => {\n  const id = req.params.id;\n  const row = await prisma.user.findUnique({ where: { id } });\n  res.json(row);\n});\n'),
    ("src/admin/guard.ts", "export function isAdmin(user) {\n  if (user.email.endsWith('@corp.test')) return true;\n  const role = user.role ?? 'admin';\n  return role === 'admin';\n}\n"),
    ("src/auth/session.js", "const ok = userId === 'anonymous' || true;\nif (role || 'owner') next();\nconst payload = jwt.verify(t, key);\n"),
    ("src/env/debug.ts", "router.get('/debug', (req, res) => {\n  res.json({ env: process.env });\n  logger.info('env', process.env);\n  return process.env;\n});\n"),
    ("src/hooks/pay.ts", "import { Webhook } from '../webhooks';\napp.post('/api/webhook', (req, res) => {\n  if (signature == expected) done();\n  new Webhook('x');\n});\n"),
    ("api/items.py", "@app.get('/items/{item_id}')\ndef read(item_id: int, q: str):\n    obj = session.get(Item, item_id)\n    return dict(os.environ)\n"),
    ("api/flask_app.py", "@bp.route('/hooks/build')\ndef hook():\n    decoded = decode(token, options={'verify_signature': False})\n    return jsonify(os.environ)\n"),
    ("app/routes/orders.$id.tsx", "export const loader = async ({ params }) => {\n  return db.select().from(orders).where(eq(orders.id, params.id));\n};\nexport async function action({ request }) {\n  const q = request.query.id;\n}\n"),
    ("app/api/pay/route.ts", "export async function POST(req) {\n  const { orderId } = await req.json();\n  await db.query('SELECT * FROM orders WHERE id = $1', [orderId]);\n}\n"),
    ("cmd/main.go", "func main() {\n\tid := chi.URLParam(r, \"id\")\n\trow := db.QueryRow(\"select 1 where id = ?\", id)\n\tjson.Marshal(os.Environ())\n\thttp.HandleFunc(\"/webhook\", h)\n}\n"),
    ("app/models/user.rb", "user = User.find(params[:id])\nrole = params[:role] || 'admin'\n"),
    ("src/chain.ts", "router\n  .get(\n    '/a', h)\n  .post('/b', h);\nconst a = req.query.a;\nconst b = await Model.findOne(a);\nawait Model.deleteMany({});\n"),
    ("tests/login.test.ts", "app.get('/x', h); const id = req.params.id; Model.findById(id);\n"),
    ("src/page.tsx", "import \"server-only\";\nconst id = req.params.id;\nModel.findById(id);\n"),
    ("README.md", "app.get('/users')\n"),
    ("src/empty.ts", ""),
    ("src/crlf.ts", "const x = 1;\r\nconst id = req.body.userId;\r\n\r\nconst row = repo.findOneBy({ id });\r\n"),
    ("src/plain.ts", "export const add = (a, b) => a + b;\n"),
    ("src/consts.ts", "export const DEFAULT_ADMIN_ID = 7;\nconst ADMIN_EMAILS = ['a@x.test'];\nif (email === 'root@x.test') grant();\n"),
    ("src/far.ts", "const id = req.params.id;\n" + "// pad\n" * 199 + "Model.findById(id);\n" + "// pad\n" + "Model.destroy({ where: 1 });\n"),
]
#: Our own small repo: path, content. Its exports run in circles, some names lead nowhere.
MODULES = [
    ("tsconfig.json", '{\n  // paths\n  "compilerOptions": { "baseUrl": ".", /* from the top */ "paths": { "@/*": ["./src/*"], "@lib": ["src/lib/index"], "@/deep/*": ["src/inner/*"], } }\n}\n'),
    ("src/app.ts", 'import express from "express";\nimport { users as userRoutes, audit } from "./routes";\nimport * as guards from "@/guards";\nimport admin from "./routes/admin";\nimport { logger } from "@lib";\nconst app = express();\napp.use(logger);\napp.use("/api", guards.requireUser, userRoutes);\n// app.use("/old", userRoutes);\napp.use(\n  "/admin", audit,\n  admin);\napp.get("/health", ping);\nfunction ping(req, res) { res.send("ok"); }\nexport default app;\n'),
    ("src/routes/index.ts", "export { router as users } from './users';\nexport * from '../shared';\nexport * from './loop';\n"),
    ("src/routes/users.ts", 'import { Router } from "express";\nimport { requireOwner } from "@/guards";\nexport const router = Router();\nrouter.use("/:id", requireOwner);\nrouter.get("/", list);\nrouter.post("/:id/keys", requireOwner, limit(5), async (req, res) => {\n  const x = { a: [1, 2] };\n  res.json(x);\n});\nrouter.use(late);\nasync function list(req, res) { res.json([]); }\nconst late = list;\n'),
    ("src/routes/admin.js", "const { Router } = require('express');\nconst { requireAdmin: need } = require('../guards');\nconst own = Router();\nown.get('/stats', need, (req, res) => res.json({}));\nmodule.exports = own;\n"),
    ("src/guards.ts", 'export function requireUser(req, res, next) { next(); }\nexport const requireOwner = requireUser;\nasync function check(req, res, next) { if (req.user) { next(); } }\nexport { check as requireAdmin };\n'),
    ("src/shared/index.ts", 'export { audit } from "./audit.js";\nexport * from "../routes/loop";\n'),
    ("src/shared/audit.ts", "const trail = (req, res, next) => next();\nexport { trail as audit };\nexport default class Audit {}\n"),
    ("src/routes/loop.ts", 'export * from "./index";\nexport * from "../shared";\n'),
    ("src/lib/index.js", "export const logger = (req, res, next) => next();\n"),
    ("src/inner/x.ts", 'import app from "../app";\nimport { users, gone } from "@/routes";\nimport { missing } from "@/guards";\nimport lost from "./lost";\nimport { deep } from "@/deep/x";\nconst log = require("@lib").logger;\nconst all = require("../shared");\nexport const deep = app;\n'),
]
#: Unified diffs: scan id, diff.
DIFFS = [
    ("d1", "diff --git a/src/a.ts b/src/a.ts\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,3 +1,4 @@\n one\n+two\n three\n-four\n+five\n+++six\n+seven\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -10,2 +20,0 @@\n-gone\n-gone too\n@@ -40 +50,2 @@\n x\n+y\n\\ No newline at end of file\n"),
    ("d2", "diff --git a/c.go b/c.go\n--- /dev/null\n+++ b/c.go\n@@ -0,0 +1,2 @@\n+package main\n+func main() {}\n@@ bad header @@\n ctx\n+late\n@@ worse @@\n+later\ndiff --git a/d.ts b/d.ts\n--- a/d.ts\n+++ b/d.ts\n@@ -5,0 +6,1 @@\n+only\r\n-cut\n ctx\n-cut\n"),
    ("d3", "no diff at all\n"),
    ("d4", "diff --git a/e.ts b/e.ts\n--- a/e.ts\n+++ b/e.ts\n@@ -1,1 +1,1 @@\n-old\n\\ No newline at end of file\n-older\n+new\n"),
]
#: Mounts: parent, child, prefix. A diamond, a chain, and a loop.
MOUNTS = [("app", "api", "/api"), ("api", "users", "/users/"), ("api", "orders", "orders"), ("app", "orders", "/legacy"), ("users", "keys", "/:id/keys"), ("loop_a", "loop_b", "/b"), ("loop_b", "loop_a", "/a"), ("app", "dyn", "<dynamic>")]
ROUTE_ROWS = [(1, "users", "/", 10), (2, "orders", "/:id", 20), (3, "keys", "/rotate", 30), (4, "app", "health", 5), (5, "dyn", "/x", 6)]
USES = [("users", 5, None, "requireUser"), ("users", 15, "/", "late"), ("orders", 3, "/:id", "requireOwner"), ("orders", 4, "/admin", "requireAdmin"), ("keys", 1, "/rot", "nope"), ("app", 1, None, "log")]
LAYOUT_FILES = [
    "app/routes/admin+/users+/list.tsx", "app/routes/admin+/_layout.tsx", "app/routes/admin+/users+/_layout.ts", "app/routes/admin+/users+/_layout.js", "app/routes/_layout.tsx",
    "app/routes/shop/cart.tsx", "app/routes/shop/_layout.tsx", "app/routes/team_+/m.tsx", "app/routes/team_+/_layout.tsx", "app/routes/admin+/solo_.tsx", "lib/x.ts",
]
NODES = [(1, "declaration", "a.ts", 1, 20), (1, "guard", "g.ts", 5, 9), (2, "handler", "a.ts", 15, 40), (3, "call@1", "b.ts", 1, 3)]
WINDOWS = [("a.ts", 18, 25), ("b.ts", 9, 12)]
HUNKS = [("a.ts", 16, 18), ("g.ts", 5, 9), ("b.ts", 3, 4)]
#: Tenant settings: tenant, threshold, globs, enabled detectors.
SETTINGS = [(0, "low", [], None), (1, "medium", ["src/**/*.ts"], None), (2, "low", [], []), (3, "low", ["**/{a,b}/*.py"], ["idor", "unknown"]), (4, "high", [], ["unknown"])]
#: Recorded verdicts: key, index, place, is_vulnerable, confidence, caller, operation.
VERDICTS = [
    ("f0", 0, 0, True, "HIGH", "authenticated", "ordinary"), ("f0", 0, 1, False, "low", "unclear", "unclear"), ("f1", 0, 0, True, "medium", None, None), ("f2", 0, 0, True, "high", "unauthenticated", "ordinary"),
    ("f3", 0, 0, True, "high", "authenticated", "administrative"), ("f4", 0, 0, True, "certain", "authenticated", "ordinary"), ("f5", 0, 0, False, "high", "authenticated", "ordinary"), ("f6", 0, 0, True, "low", "x", "y"), ("f7", 9, 0, True, "high", "authenticated", "ordinary"),
]
#: What was asked: key, index, family, route trigger.
ASKED = [("f0", 0, "idor", False), ("f1", 0, "admin-check", False), ("f2", 0, "idor", False), ("f3", 0, "auth-bypass", True), ("f4", 0, "idor", False), ("f5", 0, "env-exposure", False), ("f6", 0, "idor", False), ("f7", 0, "idor", False)]
PAYLOADS = ['{"action":"opened"}', '{"action":"edited","changes":{"base":{"ref":"x"}}}', '{"action":"edited","changes":{"title":1}}', '{"action":"labeled"}', '{"action":"danced"}', '{"number":1}', '{"action":"synchronize"}', '{"action":"edited","changes":{"base":"x"}}']
PRICES = [("large", 15.0, 75.0), ("medium", 3.0, 15.0), ("small", 0.8, 4.0), ("other", 5.0, 25.0)]
#: Scanner findings: id, rule, message, metadata, code, dialect.
SCANNED_SQL = [
    (1, "javascript.express.sql-injection", "SQL injection: string concatenated into query", "CWE-89 injection sql owasp A03", "db.query('SELECT * FROM t WHERE id = ' + id);", "postgres"),
    (2, "style.note", "documentation only: sql example", "", "const s = 'a' + 'b';", "mysql"),
    (3, "generic.raw-query", "dynamic SQL", "technology sql", "q = \"SELECT a FROM t WHERE x = '\" + x + \"' AND y = '\" + y + \"'\"", "mysql"),
    (4, "custom", "uses sql", "", "db.query(`SELECT * FROM t WHERE a = ${req.a} AND b LIKE '%${b}%'`)", "postgres"),
    (5, "custom", "plain", "", "return 1", "mysql"),
    (6, "x", "query concatenation with sql", "cwe 89", "'UPDATE t SET a = ' + a + ', b = ' + b + ' WHERE c = ' + c", "postgres"),
]


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a query under its name, with its SQL if there is one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return query


def sql_literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(sql_literal, x)) + "]::VARCHAR[]"
    return "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list) -> str:
    """A common table expression with the rows."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows) + ")"


def inline(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def dealt(spark: SparkSession, sf_dir: str, schema: str, rows: list, key: str | None = None) -> DataFrame:
    """One of `rows` for each document, dealt by its doc_id; the column `key`, if named, becomes doc_id/key, so that it stays one row's."""
    few = inline(spark, "_k long, " + schema, [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)])
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(rows)).alias("_k"))
    out = docs.join(F.broadcast(few), "_k").drop("_k")  # the rows of this module
    return out.withColumn(key, F.concat_ws("/", "doc_id", key)) if key else out


def dealt_sql(name: str, columns: str, rows: list, key: str | None = None) -> str:
    """The same as a common table expression."""
    numbered = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    listed = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in numbered)
    return f"{name} AS (SELECT doc_id, v.* EXCLUDE (_k){f" REPLACE (doc_id || '/' || {key} AS {key})" if key else ''} FROM documents JOIN (VALUES {listed}) v(_k, {columns}) ON doc_id % {len(rows)} = _k)"


#: Folder, name and content of the snippets.
PLACED = [(path[: path.rfind("/") + 1], path[path.rfind("/") + 1 :], content) for path, content in SNIPPETS]


def document_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the folder of one of the snippets: its text, then the snippet."""
    texts = spread(table(spark, sf_dir, "documents")).select("text", F.col("doc_id"), (F.col("doc_id") % len(PLACED)).alias("_k"))
    few = inline(spark, "_k long, folder string, name string, content string", [(i, *r) for i, r in enumerate(PLACED)])
    return texts.join(F.broadcast(few), "_k").select(F.concat("folder", F.col("doc_id").cast("string"), F.lit("-"), "name").alias("path"), F.concat("text", F.lit("\n"), "content").alias("content"))


DOCUMENT_SNIPPETS_SQL = f"""{dealt_sql('placed', 'folder, name, content', PLACED)}, files AS (SELECT folder || doc_id || '-' || name AS path, text || chr(10) || content AS content FROM placed JOIN documents USING (doc_id))"""


def snippets(spark: SparkSession) -> DataFrame:
    return inline(spark, "path string, content string", SNIPPETS)


SNIPPETS_SQL = values("files", "path, content", SNIPPETS)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path and content."""
    return spread(table(spark, sf_dir, "documents")).select(F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.col("text").alias("content"))


DOCUMENTS_SQL = "files AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, text AS content FROM documents)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scan runs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "retrying").otherwise("running")).otherwise("pending")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("installation"), F.concat(F.lit("repo"), (F.col("o_orderkey") % 7).cast("string")).alias("repo"), (F.col("o_orderkey") % 3).alias("pull"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"), (F.col("o_orderkey") % 5).alias("findings"))


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS installation, 'repo' || (o_orderkey % 7) AS repo, o_orderkey % 3 AS pull,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'retrying' ELSE 'running' END ELSE 'pending' END AS status,
  o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at, o_orderkey % 5 AS findings FROM orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with line items as the cost ledger, in exact cents."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    o = table(spark, sf_dir, "orders")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("org_id"), F.col("o_orderdate").alias("recorded_at"), F.col("cents").alias("cost_usd"))


LEDGER_SQL = """items AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1),
ledger AS (SELECT o_orderkey AS entry, o_custkey AS org_id, o_orderdate AS recorded_at, CAST(cents AS BIGINT) AS cost_usd FROM orders JOIN items ON o_orderkey = l_orderkey)"""


def judged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as repeated scan runs of fixtures with recorded verdicts."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (e / 5).cast("long").alias("fixture"), (F.floor(e / 5) % 3 == 0).alias("is_positive"), F.when(e % 11 == 0, "no_pattern").alias("reason"), (e % 7 != 0).alias("judged"),
        F.when(e % 13 != 0, e % 2 == 0).alias("is_vulnerable"), F.element_at(F.array(*map(F.lit, ["high", "MEDIUM", "low", "sure"])), (e % 4 + 1).cast("int")).alias("confidence"), (e % 4 == 0).alias("flagged"),
    )


JUDGED_SQL = """judged AS (SELECT event_id // 5 AS fixture, (event_id // 5) % 3 = 0 AS is_positive, CASE WHEN event_id % 11 = 0 THEN 'no_pattern' END AS reason, event_id % 7 <> 0 AS judged,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 2 = 0 END AS is_vulnerable, ['high', 'MEDIUM', 'low', 'sure'][event_id % 4 + 1] AS confidence, event_id % 4 = 0 AS flagged FROM events),
bucketed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'pre-filtered' WHEN NOT judged THEN 'no-verdict'
  WHEN is_vulnerable IS NOT NULL AND lower(confidence) IN ('high', 'medium', 'low') THEN CASE WHEN is_vulnerable THEN 'vulnerable' ELSE 'safe' END || '-' || lower(confidence) ELSE 'unclassified' END AS bucket,
  coalesce(is_vulnerable, false) AND judged AS asserted FROM judged)"""
