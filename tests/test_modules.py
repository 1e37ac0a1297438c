"""Module tables against known cases and small plain walks."""

import json
import re

from pyspark.sql import functions as F

from gristmill.operators import modules as M
from gristmill.plans import stand_ins as S

FILES = "repo string, path string, content string"


def files(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], FILES)


def heads(spark, code):
    return M.statements(M.tokens(files(spark, [("a.ts", code)])))


def test_tokens_keep_strings_and_drop_comments(spark):
    code = "a = \"x // no\\\" {\" // gone {\n/* gone\n( */ b('it\\'s', `t\n${y}`);\n"
    got = M.tokens(files(spark, [("a.ts", code), ("empty.ts", ""), ("null.ts", None), ("open.ts", "f(] }) 'x")])).orderBy("path", "n").collect()
    mine = [(r.token, r.line, r.depth) for r in got if r.path == "a.ts"]
    assert mine == [("a", 1, 0), ("=", 1, 0), ('"x // no\\" {"', 1, 0), ("b", 3, 0), ("(", 3, 0), ("'it\\'s'", 3, 1), (",", 3, 1), ("`t\n${y}`", 3, 1), (")", 4, 0), (";", 4, 0)]
    assert [r.token for r in got if r.path == "open.ts"] == ["f", "(", "]", "}", ")", "'", "x"] and not any(r.path == "empty.ts" for r in got)


def test_long_strings_and_files(spark):
    code = "const a = '" + "\\'x" * 40_000 + "';\nimport b from './b';\n"
    assert [r.name for r in M.imports(heads(spark, code)).collect()] == ["b"]
    assert M.tokens(files(spark, [("a.ts", "x " * 1_000_001)])).count() == 0  # beyond the longest


IMPORTS = [
    ("import a from 'x';", {("a", "x", "default")}), ("import * as a\n  from \"x\"", {("a", "x", "*")}), ("import a, { b as c, type d } from 'x'\n", {("a", "x", "default"), ("c", "x", "b"), ("d", "x", "d")}),
    ("import 'x';", set()), ("import type { T } from './t'", {("T", "./t", "T")}), ("const a = require('x');", {("a", "x", "*")}), ("const { a, b: c } = require('x')", {("a", "x", "a"), ("c", "x", "b")}),
    ("var l = require('x').log;", {("l", "x", "log")}), ("function f() { const a = require('x'); }", set()), ("// import a from 'x'\nlet s = \"import b from 'y'\";", set()), ("import a, * as b from 'x';", {("a", "x", "default"), ("b", "x", "*")}),
]


def by_file(spark, cases, read, columns):
    """What `read` finds in each case's statements, all in one job."""
    found = read(M.statements(M.tokens(files(spark, [(f"{i}.ts", code) for i, (code, _) in enumerate(cases)])))).collect()
    return [{tuple(r[c] for c in columns) for r in found if r.path == f"{i}.ts"} for i in range(len(cases))]


def test_imports(spark):
    assert by_file(spark, IMPORTS, M.imports, ("name", "spec", "imported")) == [want for _, want in IMPORTS]


EXPORTS = [
    ("export { a, b as c };", {("a", "a", None), ("c", "b", None)}), ("export { a as default } from './x'", {("default", "a", "./x")}), ("export * from \"./x\";", {("*", "*", "./x")}), ("export default app;", {("default", "app", None)}),
    ("export default async function go() {}", {("default", "go", None)}), ("export async function* it() {}", {("it", "it", None)}), ("export class K {}", {("K", "K", None)}), ("export const x = 1, y = 2", {("x", "x", None)}),
        ("module.exports = r;", {("default", "r", None)}), ("module.exports = { a }", set()), ("export default new K();", set()), ("export default f(x);", set()),
]


def test_exports(spark):
    assert by_file(spark, EXPORTS, M.exports, ("exported", "local", "spec")) == [want for _, want in EXPORTS]


def test_normal(spark):
    paths = {"a/./b//c": "a/b/c", "a/../../b": "b", "./x": "x", "a/b/../..": "", "../../q/r": "q/r", "": ""}
    assert list(spark.range(1).select(*(M.normal(F.lit(p)) for p in paths)).first()) == list(paths.values())


def test_resolution_goes_through_cycles_in_the_order_of_stars(spark):
    rows = [
        ("a.ts", "import { x, y, z, me } from './b'\nimport * as ns from './b'\n"), ("b.ts", "export * from './c'\nexport * from './d'\nexport { me } from './b'\n"), ("c.ts", "export * from './b'\nexport const y = 1\n"),
        ("d.ts", "export const x = own\nconst own = x\nexport function y() {}\nexport class z {}\n"),
    ]
    m = M.read(files(spark, rows))
    names = m["imports"].select("repo", "path", "name").unionByName(spark.createDataFrame([("r", "a.ts", n) for n in ("ns.z", "ns.gone", "nothing", "x.y")], "repo string, path string, name string"))
    got = {r.name: (r.to_path, r.to_name, r.kind) for r in M.resolve(names, m["steps"]).collect()}
    assert got == {"y": ("c.ts", "y", "var"), "z": ("d.ts", "z", "class"), "ns": ("b.ts", "*", "namespace"), "ns.z": ("d.ts", "z", "class")}  # x and own name each other, me itself


def test_route_map_of_the_small_repo(spark):
    found = {(r.method, r.path): r for r in M.route_map(files(spark, S.MODULES)).collect()}
    assert set(found) == {("get", "/health"), ("get", "/admin/stats"), ("get", "/api"), ("post", "/api/:id/keys")}
    keys = found["post", "/api/:id/keys"]
    assert keys.guards == ["mount:logger", "mount:guards.requireUser", "router:requireOwner", "route:requireOwner", "route:limit"] and keys.through == ["r:src/app.ts#app"] and keys.handler == "<inline>"
    assert found["get", "/api"].guards == ["mount:logger", "mount:guards.requireUser"]  # /:id doesn't cover /, and late comes after it
    assert found["get", "/api"].handler_at == "src/routes/users.ts#list" and found["get", "/health"].guards == ["router:logger"]


def test_a_map_is_the_same_however_files_are_dealt(spark):
    few = files(spark, S.MODULES)
    maps = {tuple(M.serialised(M.route_map(few.repartition(n, F.rand(n))), few).first()) for n in (1, 7, 64)}
    assert len(maps) == 1
    text = next(iter(maps))[3]
    rows = json.loads(text)["routes"]
    assert text.endswith("\n") and [r["line"] for r in rows] == [13, 4, 5, 6] and re.fullmatch("[0-9a-f]{64}", next(iter(maps))[4])


def test_nothing_to_read(spark):
    none = files(spark, [])
    assert M.route_map(none).collect() == [] and M.serialised(M.route_map(none), none).collect() == []
    bare = files(spark, [("a.ts", "const x = 1"), ("tsconfig.json", "not json")])
    assert [r.n_routes for r in M.serialised(M.route_map(bare), bare).collect()] == [0]


def test_comments_of_any_shape_are_tokens_as_before_and_their_text_is_not_shuffled(spark):
    sources = ["/**/a", "/***/ b /* x * / y **/ c", "/* open ; d", "/*" + "* " * 200_000 + "*/ e", "/* \n\n */ f // g */\nh", "/*/ i */ j", "a /* b \n*/ { /* } */ }", "'/* k */' /* l */"]
    files = spark.createDataFrame([("r", str(i), x) for i, x in enumerate(sources)], "repo string, path string, content string")
    got = {(r["path"], r["n"]): (r["token"], r["line"], r["depth"]) for r in M.tokens(files).collect()}
    want = {}
    for i, x in enumerate(sources):
        line, depth = 1, 0
        for n, t in enumerate(re.findall(M.TOKEN, x)):
            depth -= t in ")]}"
            if t != "\n" and not t.startswith(("//", "/*")):
                want[str(i), n] = t, line, depth
            depth += t in "([{"
            line += t.count("\n")
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    plan = M.tokens(files)._jdf.queryExecution().executedPlan().toString()
    assert "THEN token" in plan.split("Exchange")[-1] and "/\\*[\\s\\S]*?" not in plan
