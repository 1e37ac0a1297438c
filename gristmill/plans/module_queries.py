"""Queries over module tables: every document is a file of a small repo, the document's text a comment before the file's code."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import modules
from gristmill.plans import stand_ins as S
from gristmill.plans.scan_queries import join_sql
from gristmill.runtime import cut, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = S.registrar(QUERIES, ORACLE_SQL)
Q = S.sql_literal

N, STR = modules.NAME, modules.STRING
REQUIRE = rf"= require \( {STR} \)"
LISTED = r"\{([^}]*)\}"
CANDIDATES = [("base", ""), *(("bare", e) for e in modules.EXTENSIONS), *(("base", f"/index{e}") for e in modules.EXTENSIONS)]


def ex(regex: str, group: int = 1, of: str = "head") -> str:
    return f"regexp_extract({of}, {Q(regex)}, {group})"


def has(regex: str, of: str = "head") -> str:
    return f"regexp_matches({of}, {Q(regex)})"


def elements(source: str, sep: str, extra: str, where: str) -> str:
    """Rows (repo, path, extra, name, imported) of the braced lists in the heads of `source`."""
    inner = f"SELECT repo, path, {extra}, trim(unnest(string_split({ex(LISTED)}, ','))) AS x FROM {source} WHERE {where}"
    name = f"CASE WHEN {ex(rf' {sep} ({N})$', of='x')} <> '' THEN {ex(rf' {sep} ({N})$', of='x')} ELSE {ex(rf'({N})$', of='x')} END"
    return f"SELECT * FROM (SELECT * EXCLUDE (x), {name} AS name, {ex(rf'^(?:type )?({N})', of='x')} AS imported FROM ({inner})) WHERE name <> ''"


def normal_sql(path: str) -> str:
    return f"list_reduce(string_split({path}, '/'), lambda o, p: CASE WHEN p IN ('', '.') THEN o WHEN p = '..' THEN regexp_replace(o, '(?:^|/)[^/]+$', '') ELSE o || CASE WHEN o = '' THEN '' ELSE '/' END || p END, '')"


FILES_SQL = f"""{S.values('own', 'file, code', S.MODULES)}, numbered AS (SELECT *, row_number() OVER () - 1 AS k FROM own),
files AS (SELECT 'r' || (doc_id // {len(S.MODULES)}) AS repo, file AS path, '/* ' || replace(coalesce(text, ''), '*/', '') || ' */' || chr(10) || code AS content FROM documents JOIN numbered ON doc_id % {len(S.MODULES)} = k)"""
TOKENS_SQL = f"""tok AS (SELECT repo, path, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS n FROM (SELECT repo, path, regexp_extract_all(content, {Q(modules.TOKEN)}) AS l FROM files WHERE length(content) <= {modules.LONGEST})),
marked AS (SELECT *, length(token) - length(replace(token, chr(10), '')) AS br, CAST(token IN ('(', '[', '{{') AS INT) AS o, CAST(token IN (')', ']', '}}') AS INT) AS c FROM tok),
placed AS (SELECT repo, path, n, token, CAST(sum(br) OVER w - br + 1 AS INTEGER) AS line, sum(o - c) OVER w - o AS depth FROM marked WINDOW w AS (PARTITION BY repo, path ORDER BY n)),
code AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n) AS i FROM placed WHERE token <> chr(10) AND NOT starts_with(token, '//') AND NOT starts_with(token, '/*'))"""
HEADS_SQL = f"""begun AS (SELECT *, depth = 0 AND token IN ({', '.join(map(Q, modules.STARTERS))}) AND (lag(token) OVER w IS NULL OR lag(token) OVER w IN (';', '}}') OR lag(line) OVER w < line) AS b FROM code WINDOW w AS (PARTITION BY repo, path ORDER BY i)),
owned AS (SELECT *, max(CASE WHEN b THEN i END) OVER (PARTITION BY repo, path ORDER BY i) AS s FROM begun),
st AS (SELECT repo, path, min(n) AS stmt, min(line) AS line, string_agg(token, ' ' ORDER BY i) AS head FROM owned WHERE s IS NOT NULL AND i - s < {modules.HEAD} GROUP BY repo, path, s)"""
SPEC = ex(rf"^import (?:.* from )?{STR}")
DEFAULT, SPACE = rf"^import (?:type )?({N}) (?:,|from )", rf"^import (?:type )?(?:{N} , )?\* as ({N}) from "
WHOLE, PART = rf"^(?:const|let|var) ({N}) {REQUIRE}", rf"{REQUIRE} \. ({N})"
IMPORTS_SQL = f"""imports AS (SELECT repo, path, {SPEC} AS spec, {ex(DEFAULT)} AS name, 'default' AS imported FROM st WHERE {has(DEFAULT)}
 UNION ALL SELECT repo, path, {SPEC}, {ex(SPACE)}, '*' FROM st WHERE {has(SPACE)}
 UNION ALL {elements('st', 'as', SPEC + ' AS spec', has(LISTED.join(['^import [^{]*', ' from '])))}
 UNION ALL SELECT repo, path, {ex(REQUIRE)}, {ex(WHOLE)}, CASE WHEN {has(PART)} THEN {ex(PART, 2)} ELSE '*' END FROM st WHERE {has(WHOLE)}
 UNION ALL {elements('st', ':', ex(REQUIRE) + ' AS spec', has(rf'^(?:const|let|var) {LISTED} {REQUIRE}'))})"""
DECLARED, BOUND, PLAIN = rf"^export (?:async )?(?:function|class) (?:\* )?({N})", rf"^export (?:const|let|var) ({N})", rf"^export default ({N})(?: ;| [^.(]|$)"
OWN, CJS = rf"^export default (?:async )?(?:function|class) (?:\* )?({N})", rf"^module \. exports = ({N})(?: ;|$| [^.(])"
FROM = rf"^export (?:\*|\{{[^}}]*\}}) from {STR}"
ESPEC = f"CASE WHEN {has(FROM)} THEN {ex('from ' + STR)} END AS spec, stmt AS ord"
EXPORTS_SQL = f"""exports AS (SELECT repo, path, {ESPEC}, '*' AS exported, '*' AS local FROM st WHERE {has(r'^export [*] from ')}
 UNION ALL {elements('st', 'as', ESPEC, has('^export ' + LISTED))}
 UNION ALL SELECT repo, path, NULL, stmt, {ex(DECLARED)}, {ex(DECLARED)} FROM st WHERE {has(DECLARED)}
 UNION ALL SELECT repo, path, NULL, stmt, {ex(BOUND)}, {ex(BOUND)} FROM st WHERE {has(BOUND)}
 UNION ALL SELECT repo, path, NULL, stmt, 'default', {ex(OWN)} FROM st WHERE {has(OWN)}
 UNION ALL SELECT repo, path, NULL, stmt, 'default', {ex(PLAIN)} FROM st WHERE NOT {has(OWN)} AND {has(PLAIN)} AND {ex(PLAIN)} NOT IN ('async', 'function', 'class', 'new')
 UNION ALL SELECT repo, path, NULL, stmt, 'default', {ex(CJS)} FROM st WHERE {has(CJS)})"""
FUNCTION, CLASS, VAR = (rf"^(?:export )?(?:default )?{x}({N})" for x in (r"(?:async )?function (?:\* )?", "class ", "(?:const|let|var) "))
VALUE, ALIAS = rf"^(?:export )?(?:const|let|var) {N} = (.*)$", rf"^({N})(?: ;.*| (?:{'|'.join(modules.STARTERS)}|{N}) .*|)$"
DECLS_SQL = f"""valued AS (SELECT repo, path, stmt, line, coalesce(nullif({ex(FUNCTION)}, ''), nullif({ex(CLASS)}, ''), nullif({ex(VAR)}, '')) AS name, {ex(VALUE)} AS v,
  CASE WHEN {has(FUNCTION)} THEN 'function' WHEN {has(CLASS)} THEN 'class' END AS fixed FROM st WHERE NOT {has(REQUIRE)}),
kinds AS (SELECT *, coalesce(fixed, CASE WHEN {has(modules.RECEIVER_FACTORY, 'v')} THEN 'receiver' WHEN {has(ALIAS, 'v')} AND NOT {has('^(?:async|function|class|new|await) ', 'v')} THEN 'alias' ELSE 'var' END) AS kind FROM valued WHERE name IS NOT NULL),
decls AS (SELECT repo, path, name, arg_min(kind, stmt) AS kind, arg_min(line, stmt) AS line, arg_min(CASE WHEN kind = 'alias' THEN {ex(ALIAS, of='v')} ELSE '' END, stmt) AS other FROM kinds GROUP BY ALL)"""
BARE = "regexp_replace(regexp_replace(regexp_replace(content, '/\\*[\\s\\S]*?\\*/', '', 'g'), '(?m)^\\s*//.*$', '', 'g'), ',\\s*([}\\]])', '\\1', 'g')"
TARGETS_SQL = f"""conf AS (SELECT repo, CAST({BARE} AS JSON) AS j FROM files WHERE path IN ({', '.join(map(Q, modules.CONFIGS))})),
pathed AS (SELECT repo, coalesce(j ->> '$.compilerOptions.baseUrl', '.') AS base, unnest(json_keys(j, '$.compilerOptions.paths')) AS key, j -> '$.compilerOptions.paths' AS p FROM conf),
aliases AS (SELECT repo, regexp_replace(key, '/?\\*$', '') AS prefix, {normal_sql("base || '/' || regexp_replace(json_extract_string(p, '$.\"' || key || '\"[0]'), '/?[*]$', '')")} AS target FROM pathed),
asked_specs AS (SELECT repo, path, spec FROM imports UNION SELECT repo, path, spec FROM exports WHERE spec IS NOT NULL),
aliased AS (SELECT s.repo, s.path, s.spec, a.prefix, a.target, row_number() OVER (PARTITION BY s.repo, s.path, s.spec ORDER BY length(prefix) DESC) AS r FROM asked_specs s JOIN aliases a ON s.repo = a.repo AND (s.spec = a.prefix OR starts_with(s.spec, a.prefix || '/')) WHERE NOT starts_with(s.spec, '.')),
based AS (SELECT repo, path, spec, {normal_sql("regexp_replace(path, '[^/]*$', '') || spec")} AS base FROM asked_specs WHERE starts_with(spec, '.')
  UNION ALL SELECT repo, path, spec, {normal_sql("target || substr(spec, length(prefix) + 1)")} FROM aliased WHERE r = 1),
tries AS (SELECT *, regexp_replace(base, '\\.(?:js|mjs|cjs|jsx)$', '') AS bare FROM based),
targets AS (SELECT t.repo, t.path, t.spec, arg_min(c.target, c.k) AS target FROM tries t, LATERAL (SELECT unnest([{', '.join(f"{a} || {Q(e)}" for a, e in CANDIDATES)}]) AS target, unnest(range({len(CANDIDATES)})) AS k) c
  WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo = t.repo AND f.path = c.target) GROUP BY ALL)"""
STEPS_SQL = """steps AS (SELECT repo, path, 'name' AS space, name, path AS to_path, 'name' AS to_space, name AS to_name, 0 AS ord, kind FROM decls WHERE kind <> 'alias' OR other = name
 UNION ALL SELECT repo, path, 'name', name, path, 'name', other, 0, NULL FROM decls WHERE kind = 'alias' AND other <> name
 UNION ALL SELECT i.repo, i.path, 'name', i.name, t.target, CASE WHEN imported = '*' THEN 'name' ELSE 'export' END, imported, 0, CASE WHEN imported = '*' THEN 'namespace' END
   FROM imports i JOIN targets t USING (repo, path, spec) WHERE NOT EXISTS (SELECT 1 FROM decls d WHERE d.repo = i.repo AND d.path = i.path AND d.name = i.name)
 UNION ALL SELECT repo, path, 'export', exported, path, 'name', local, 0, NULL FROM exports WHERE spec IS NULL
 UNION ALL SELECT e.repo, e.path, 'export', exported, t.target, 'export', local, CAST(ord AS INTEGER), NULL FROM exports e JOIN targets t USING (repo, path, spec))"""


def resolved_sql(names: str) -> str:
    """resolved(repo, path, name, to_path, to_name, kind, hops) of the relation `names` (repo, path, name)."""
    return f"""begin_at AS (SELECT DISTINCT repo, path, name FROM {names}),
walk(repo, path, name, place, space, cur, rank, seen) AS (
  SELECT b.repo, b.path, b.name, CASE WHEN contains(b.name, '.') THEN s.to_path ELSE b.path END, CASE WHEN contains(b.name, '.') THEN 'export' ELSE 'name' END, CASE WHEN contains(b.name, '.') THEN regexp_extract(b.name, '^[^.]*\\.(.*)$', 1) ELSE b.name END, CAST([] AS INTEGER[]),
    [CASE WHEN contains(b.name, '.') THEN s.to_path || '|export|' || regexp_extract(b.name, '^[^.]*\\.(.*)$', 1) ELSE b.path || '|name|' || b.name END]
  FROM begin_at b LEFT JOIN steps s ON s.kind = 'namespace' AND s.repo = b.repo AND s.path = b.path AND s.name = split_part(b.name, '.', 1) WHERE NOT contains(b.name, '.') OR s.to_path IS NOT NULL
  UNION ALL
  SELECT w.repo, w.path, w.name, s.to_path, s.to_space, CASE WHEN s.name = '*' AND s.space = 'export' THEN w.cur ELSE s.to_name END, CASE WHEN s.name = '*' AND s.space = 'export' THEN list_append(w.rank, s.ord) ELSE w.rank END,
    list_append(w.seen, s.to_path || '|' || s.to_space || '|' || CASE WHEN s.name = '*' AND s.space = 'export' THEN w.cur ELSE s.to_name END)
  FROM walk w JOIN steps s ON s.repo = w.repo AND s.path = w.place AND s.space = w.space AND s.kind IS NULL
    AND (s.name = w.cur AND NOT (s.space = 'export' AND s.name = '*') OR s.space = 'export' AND s.name = '*' AND w.cur <> 'default' AND NOT EXISTS (SELECT 1 FROM steps x WHERE x.repo = w.repo AND x.path = w.place AND x.space = 'export' AND x.name = w.cur))
  WHERE NOT list_contains(w.seen, s.to_path || '|' || s.to_space || '|' || CASE WHEN s.name = '*' AND s.space = 'export' THEN w.cur ELSE s.to_name END)),
ended AS (SELECT w.repo, w.path, w.name, s.to_path, s.to_name, s.kind, w.rank, len(w.seen) AS hops FROM walk w JOIN steps s ON s.repo = w.repo AND s.path = w.place AND s.space = w.space AND s.name = w.cur AND s.kind IS NOT NULL),
resolved AS (SELECT * EXCLUDE (r, rank) FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY rank, hops, to_path, to_name, kind) AS r FROM ended) WHERE r = 1)"""


ARG_NAME = rf"^({N}(?: \. {N})*)(?: \(.*)?$"
CALLS_SQL = f"""brackets AS (SELECT repo, path, i, lead(i) OVER (PARTITION BY repo, path, depth ORDER BY i) AS stop, depth AS level FROM code WHERE token IN ('(', '[', '{{', ')', ']', '}}')),
seen_calls AS (SELECT repo, path, n, line, i, token AS receiver, lead(token, 2) OVER w AS verb, {has(f'^{N}$', 'token')} AND coalesce(lag(token) OVER w, '') <> '.' AND lead(token) OVER w = '.' AND lead(token, 3) OVER w = '(' AS hit FROM code WINDOW w AS (PARTITION BY repo, path ORDER BY i)),
found_calls AS (SELECT c.repo, c.path, n, c.line, i + 3 AS i, receiver, verb FROM seen_calls c LEFT JOIN decls d ON d.repo = c.repo AND d.path = c.path AND d.name = c.receiver AND d.kind = 'receiver'
  WHERE hit AND verb IN ({', '.join(map(Q, (*modules.VERBS, 'use')))}) AND (d.name IS NOT NULL OR {has(modules.RECEIVER_NAME, 'receiver')})),
spans AS (SELECT f.*, b.stop, b.level FROM found_calls f JOIN brackets b USING (repo, path, i)),
inner_tokens AS (SELECT c.*, s.n AS call, s.i AS open, s.stop, s.level FROM code c ASOF JOIN spans s ON c.repo = s.repo AND c.path = s.path AND c.i >= s.i),
argued AS (SELECT *, sum(CAST(token = ',' AS INT)) OVER (PARTITION BY repo, path, call ORDER BY i) AS arg FROM inner_tokens WHERE i > open AND i < stop AND depth = level + 1),
each_arg AS (SELECT repo, path, call AS n, arg, string_agg(token, ' ' ORDER BY i) AS t FROM argued WHERE token <> ',' GROUP BY ALL),
named_args AS (SELECT *, {has(f'^{STR}$', 't')} AS quoted, CASE WHEN {has(ARG_NAME, 't')} AND NOT {has('^(?:async|function|new) ', 't')} THEN replace({ex(ARG_NAME, of='t')}, ' ', '') ELSE '<inline>' END AS name FROM each_arg),
args AS (SELECT repo, path, n, max(CASE WHEN arg = 0 AND quoted THEN {ex(STR, of='t')} END) AS place, coalesce(list(name ORDER BY arg) FILTER (WHERE arg > 0 OR NOT quoted), []) AS args FROM named_args GROUP BY ALL),
calls AS (SELECT f.repo, f.path, f.n, f.line, f.receiver, f.verb, a.place, a.args FROM found_calls f JOIN args a USING (repo, path, n) WHERE (verb = 'use' OR place IS NOT NULL) AND len(args) > 0)"""
MODULES_SQL = f"{FILES_SQL}, {TOKENS_SQL}, {HEADS_SQL}, {IMPORTS_SQL}, {EXPORTS_SQL}, {DECLS_SQL}, {TARGETS_SQL}"


def module_files(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    file, code = (F.element_at(F.array(*(F.lit(x[i]) for x in S.MODULES)), (F.col("doc_id") % len(S.MODULES) + 1).cast("int")) for i in (0, 1))
    body = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit(" */\n"), code)
    return docs.select(F.concat(F.lit("r"), F.floor(F.col("doc_id") / len(S.MODULES)).cast("string")).alias("repo"), file.alias("path"), body.alias("content"))


@query(f"WITH {MODULES_SQL} SELECT repo, path, name, spec, imported, target FROM imports LEFT JOIN targets USING (repo, path, spec)")
def module_imports(spark, sf_dir):
    """Every imported name with the file that its specifier stands for, by relative path or alias; packages have none."""
    files = module_files(spark, sf_dir)
    found = cut(modules.imports(modules.statements(modules.tokens(files))))
    return found.join(modules.spec_targets(found, files, modules.aliases(files)), ["repo", "path", "spec"], "left").select("repo", "path", "name", "spec", "imported", "target")


@query(f"WITH {FILES_SQL}, {TOKENS_SQL}, {HEADS_SQL}, {DECLS_SQL}, {EXPORTS_SQL} SELECT repo, path, name, kind, line, '' AS exported FROM decls UNION ALL SELECT repo, path, local, 'export', 0, exported FROM exports")
def module_declarations(spark, sf_dir):
    """What the modules declare, and what they export under which name."""
    stmts = modules.statements(modules.tokens(module_files(spark, sf_dir)))
    declared = modules.declarations(stmts).select("repo", "path", "name", "kind", "line", F.lit("").alias("exported"))
    return declared.unionByName(modules.exports(stmts).select("repo", "path", F.col("local").alias("name"), F.lit("export").alias("kind"), F.lit(0).alias("line"), "exported"))


@query(f"WITH RECURSIVE {MODULES_SQL}, {STEPS_SQL}, {resolved_sql('imports')} SELECT repo, path, name, to_path, to_name, kind, CAST(hops AS INTEGER) AS hops FROM begin_at LEFT JOIN resolved USING (repo, path, name)")
def symbol_resolution(spark, sf_dir):
    """What each imported name stands for, through imports, exports, aliases and star exports; null where it leads nowhere."""
    m = modules.read(module_files(spark, sf_dir), calls=False)
    return m["imports"].select("repo", "path", "name").distinct().join(modules.resolve(m["imports"], m["steps"]), ["repo", "path", "name"], "left")


@query(f"WITH {FILES_SQL}, {TOKENS_SQL}, {HEADS_SQL}, {DECLS_SQL}, {CALLS_SQL} SELECT repo, path, line, receiver, verb, place, array_to_string(args, ',') AS args FROM calls")
def router_calls(spark, sf_dir):
    """Routes, mounts and middleware as the sources write them."""
    toks = cut(modules.tokens(module_files(spark, sf_dir)))
    found = modules.router_calls(toks, modules.declarations(modules.statements(toks)))
    return found.select("repo", "path", "line", "receiver", "verb", F.col("at").alias("place"), F.array_join("args", ",").alias("args"))


COVERS = "(u.line < {0}.line AND (u.prefix IS NULL OR u.prefix IN ('/', '') OR {1} = '<dynamic>' OR {1} = regexp_replace(u.prefix, '/+$', '') OR starts_with({1}, regexp_replace(u.prefix, '/+$', '') || '/')))"
MAP_SQL = f"""{MODULES_SQL}, {STEPS_SQL}, {CALLS_SQL},
used AS (SELECT repo, path, receiver AS name FROM calls UNION SELECT repo, path, x FROM (SELECT repo, path, unnest(args) AS x FROM calls) WHERE x <> '<inline>'), {resolved_sql('used')},
nodes AS (SELECT repo, path, name, repo || ':' || to_path || '#' || to_name AS node FROM resolved WHERE kind = 'receiver'),
at_node AS (SELECT c.*, coalesce(r.node, c.repo || ':' || c.path || '#' || c.receiver) AS node FROM calls c LEFT JOIN nodes r ON r.repo = c.repo AND r.path = c.path AND r.name = c.receiver),
use_args AS (SELECT repo, path, n, line, node, place, unnest(args) AS name, generate_subscripts(args, 1) AS k FROM at_node WHERE verb = 'use'),
use_nodes AS (SELECT a.*, r.node AS child, bool_or(r.node IS NOT NULL) OVER (PARTITION BY a.repo, a.path, a.n) AS mounts FROM use_args a LEFT JOIN nodes r USING (repo, path, name)),
uses AS (SELECT node, line, n, k, place AS prefix, name FROM use_nodes WHERE NOT mounts),
mount_rows AS (SELECT m.node AS parent, m.child, coalesce(m.place, '') AS prefix, m.line, m.repo, m.path, m.n, m.k FROM use_nodes m WHERE m.child IS NOT NULL),
mounts AS (SELECT m.parent, m.child, m.prefix, list_concat(coalesce((SELECT list('mount:' || u.name ORDER BY u.line, u.n, u.k) FROM uses u WHERE u.node = m.parent AND {COVERS.format('m', 'm.prefix')}), []),
  coalesce((SELECT list('mount:' || b.name ORDER BY b.k) FROM use_nodes b WHERE b.repo = m.repo AND b.path = m.path AND b.n = m.n AND b.k < m.k AND b.child IS NULL), [])) AS guards FROM mount_rows m),
c(receiver, top, prefix, through, seen, guards, looped) AS (SELECT child, parent, prefix, [parent], [child, parent], guards, child = parent FROM mounts
  UNION ALL SELECT c.receiver, m.parent, {join_sql('m.prefix', 'c.prefix')}, list_concat([m.parent], c.through), list_append(c.seen, m.parent), list_concat(m.guards, c.guards), list_contains(c.seen, m.parent) FROM c JOIN mounts m ON m.child = c.top WHERE NOT c.looped),
ways AS (SELECT receiver, prefix, through, guards FROM c WHERE looped OR NOT EXISTS (SELECT 1 FROM mounts m WHERE m.child = c.top)),
own_rows AS (SELECT a.*, list_concat(coalesce((SELECT list('router:' || u.name ORDER BY u.line, u.n, u.k) FROM uses u WHERE u.node = a.node AND {COVERS.format('a', 'a.place')}), []), list_transform(args[:len(args) - 1], lambda x: 'route:' || x)) AS near FROM at_node a WHERE verb <> 'use'),
map AS (SELECT o.repo, o.path AS file, o.line, o.verb AS method, {join_sql("coalesce(w.prefix, '')", 'o.place')} AS path, o.receiver, coalesce(w.through, []) AS through, list_concat(coalesce(w.guards, []), o.near) AS guards, o.args[len(o.args)] AS handler, h.to_path || '#' || h.to_name AS handler_at
  FROM own_rows o LEFT JOIN ways w ON w.receiver = o.node LEFT JOIN resolved h ON h.kind = 'function' AND h.repo = o.repo AND h.path = o.path AND h.name = o.args[len(o.args)])"""


@query(f"WITH RECURSIVE {MAP_SQL} SELECT repo, file, line, method, path, receiver, array_to_string(through, '>') AS through, array_to_string(guards, ',') AS guards, handler, handler_at FROM map")
def route_map(spark, sf_dir):
    """Every route under its full path, with the guards that a request passes, in order, and its handler's declaration."""
    found = modules.route_map(module_files(spark, sf_dir))
    return found.withColumns({"through": F.array_join("through", ">"), "guards": F.array_join("guards", ",")})


ROUTE_JSON = "'{\"file\":' || to_json(file) || ',\"line\":' || line || ',\"path\":' || to_json(path) || ',\"method\":' || to_json(method) || ',\"through\":' || to_json(through) || ',\"handler\":' || to_json(handler) || ',\"receiver\":' || to_json(receiver) || ',\"guards\":' || to_json(guards) || CASE WHEN handler_at IS NULL THEN '' ELSE ',\"handler_at\":' || to_json(handler_at) END || '}'"


@query(f"""WITH RECURSIVE {MAP_SQL}, per AS (SELECT repo, count(*) AS n_routes, count(*) FILTER (WHERE len(guards) = 0) AS n_unguarded, string_agg({ROUTE_JSON}, ',' ORDER BY file, line, path, method, through, handler) AS routes FROM map GROUP BY repo)
SELECT f.repo, coalesce(n_routes, 0) AS n_routes, coalesce(n_unguarded, 0) AS n_unguarded, sha256('{{"routes":[' || coalesce(routes, '') || ']}}' || chr(10)) AS map_sha256 FROM (SELECT DISTINCT repo FROM files) f LEFT JOIN per USING (repo)""")
def route_map_json(spark, sf_dir):
    """A digest of each repo's routes in canonical form."""
    files = module_files(spark, sf_dir)
    return modules.serialised(modules.route_map(files), files).drop("map")
