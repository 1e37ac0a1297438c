"""Modules of JavaScript and TypeScript sources as tables: tokens, statements, imports, exports, declarations, calls on routers, and what a name stands for.

A declared approximation of a parser: sources become tokens (comments apart, strings whole), brackets are
matched by their depth, and statements and calls are patterns over tokens. Regular-expression literals,
several declarators in one statement, classes' members and computed names are not read.

Everything is keyed by (repo, path). Names are resolved as a fixpoint of equi-joins: each round follows
every open name one step, to a declaration, through an import, an export or a star export; a name met
again on its own way ends it, and of several ways the first in the order of star exports counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import routes
from gristmill.runtime import cut

# Fixed values.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
VERBS = ("get", "post", "put", "patch", "delete", "all", "head", "options")
RECEIVER_NAME = r"^(?:router|app|api|server|fastify|express)$|(?:Router|App|Api)$"
RECEIVER_FACTORY = r"^(?:express|Router|express \. Router|new Router|new KoaRouter|KoaRouter|fastify|Fastify|Hapi \. server|new Hapi \. Server|Hapi \. Server|restify \. createServer) \("
CONFIGS = ("tsconfig.json", "jsconfig.json", "tsconfig.base.json")
LONGEST = 2_000_000
# End of fixed values.
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
TOKEN = r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|=>|\n|[^ \t\n\r\f\x0B]"""
COMMENT = r"/\*[\s\S]*?\*/"
#: The same comments for Java, whose lazy loop takes some hundred nanoseconds a character: runs without a star, and stars without a slash.
JAVA_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
#: `TOKEN` for Java, whose repeated groups would need a stack frame each: they never have to give back what they took.
JAVA_TOKEN = TOKEN.replace(")*", ")*+").replace(COMMENT, JAVA_COMMENT)
STARTERS = ("import", "export", "const", "let", "var", "function", "class", "async", "module")
#: Tokens of a statement that are read.
HEAD = 200
KEY = ("repo", "path")
STRING = r"""["']([^"']*)["']"""


def tokens(files: DataFrame) -> DataFrame:
    """repo, path, n, token, line, depth (brackets open before it; a closing one counts as closed) of files (repo, path, content): no comments, no line ends."""
    found = files.where(F.length("content") <= LONGEST).select(*KEY, F.posexplode(F.regexp_extract_all("content", F.lit(JAVA_TOKEN), F.lit(0))).alias("n", "token"))
    comment = F.col("token").startswith("//") | F.col("token").startswith("/*")
    found = found.select(*KEY, "n", F.when(~comment, F.col("token")).alias("token"), (F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))).alias("breaks"))  # a comment's line ends are shuffled, not its text
    of_file = Window.partitionBy(*KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = (F.coalesce(F.col("token").isin(*x), F.lit(False)).cast("int") for x in ("([{", ")]}"))
    placed = found.withColumns({"line": (F.sum("breaks").over(of_file) - F.col("breaks") + 1).cast("int"), "depth": (F.sum(opens - closes).over(of_file) - opens).cast("int")})
    return placed.where("token <> '\n'").drop("breaks")


def statements(toks: DataFrame) -> DataFrame:
    """repo, path, line, stmt (its first token's n), head: the first tokens, joined by blanks, of statements outside all brackets that begin with one of `STARTERS`."""
    order = Window.partitionBy(*KEY).orderBy("n")
    before, line = F.lag("token").over(order), F.lag("line").over(order)
    begins = (F.col("depth") == 0) & F.col("token").isin(*STARTERS) & (before.isNull() | before.isin(";", "}") | (line < F.col("line")))
    own = toks.withColumn("b", F.when(begins, F.struct("n", "line"))).withColumn("b", F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = own.where("b IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "b.n").orderBy("n"))).where(F.col("r") <= HEAD)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ")
    return ranked.groupBy(*KEY, F.col("b.n").alias("stmt"), F.col("b.line").alias("line")).agg(listed.alias("head"))


def _listed(inside: Column, name: Column, imported: str, sep: str) -> Column:
    """The elements of a braced list: (name, imported) of `a`, and of `a as b` or `a : b`."""
    one = lambda x: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, rf" {sep} ({NAME})$", 1), F.lit("")), F.regexp_extract(x, rf"({NAME})$", 1)).alias("name"), F.regexp_extract(x, rf"^(?:type )?({NAME})", 1).alias("imported"))
    return F.filter(F.transform(F.split(inside, ","), lambda x: one(F.trim(x))), lambda x: x["name"] != "")


def imports(stmts: DataFrame) -> DataFrame:
    """repo, path, name, spec, imported ('default', '*' or a name) of import statements and of requires that are bound to names."""
    head = F.col("head")
    group = lambda regex, i=1: F.regexp_extract("head", regex, i)
    spec = group(rf"^import (?:.* from )?{STRING}")
    single = lambda regex, imported: F.when(head.rlike(regex), F.array(F.struct(group(regex).alias("name"), F.lit(imported).alias("imported"))))
    none = F.array().cast("array<struct<name:string,imported:string>>")
    bound = F.concat(
        F.coalesce(single(rf"^import (?:type )?({NAME}) (?:,|from )", "default"), none), F.coalesce(single(rf"^import (?:type )?(?:{NAME} , )?\* as ({NAME}) from ", "*"), none),
        F.coalesce(F.when(head.rlike(r"^import [^{]*\{[^}]*\} from "), _listed(group(r"\{([^}]*)\}"), head, "", "as")), none),
    )
    plain = stmts.where(head.rlike("^import ")).select(*KEY, spec.alias("spec"), F.explode(bound).alias("b"))
    require = rf"= require \( {STRING} \)"
    whole, part = rf"^(?:const|let|var) ({NAME}) {require}", rf"{require} \. ({NAME})"
    member = F.when(head.rlike(part), group(part, 2)).otherwise("*")
    asked = F.when(head.rlike(whole), F.array(F.struct(group(whole).alias("name"), member.alias("imported")))).when(head.rlike(rf"^(?:const|let|var) \{{[^}}]*\}} {require}"), _listed(group(r"\{([^}]*)\}"), head, "", ":"))
    old = stmts.where(head.rlike(rf"^(?:const|let|var) [^=]*{require}")).select(*KEY, group(require).alias("spec"), F.explode(asked).alias("b"))
    return plain.unionByName(old).select(*KEY, F.col("b.name").alias("name"), "spec", F.col("b.imported").alias("imported"))


def exports(stmts: DataFrame) -> DataFrame:
    """repo, path, exported ('*' for a star), local (a name of this module, or of `spec`'s), spec (null: this module), ord (of stars)."""
    head = F.col("head")
    group = lambda regex, i=1: F.regexp_extract("head", regex, i)
    spec = F.when(head.rlike(rf"^export (?:\*|\{{[^}}]*\}}) from {STRING}"), group(rf"from {STRING}"))
    pair = lambda exported, local: F.array(F.struct(exported.alias("name"), local.alias("imported")))
    declared, bound, default = rf"^export (?:async )?(?:function|class) (?:\* )?({NAME})", rf"^export (?:const|let|var) ({NAME})", rf"^export default ({NAME})(?: ;| [^.(]|$)"
    own = rf"^export default (?:async )?(?:function|class) (?:\* )?({NAME})"
    named = (
        F.when(head.rlike(r"^export \* from "), pair(F.lit("*"), F.lit("*"))).when(head.rlike(r"^export \{[^}]*\}"), _listed(group(r"\{([^}]*)\}"), head, "", "as")).when(head.rlike(declared), pair(group(declared), group(declared)))
        .when(head.rlike(bound), pair(group(bound), group(bound))).when(head.rlike(own), pair(F.lit("default"), group(own))).when(head.rlike(default) & ~group(default).isin("async", "function", "class", "new"), pair(F.lit("default"), group(default)))
        .when(head.rlike(rf"^module \. exports = ({NAME})(?: ;|$| [^.(])"), pair(F.lit("default"), group(rf"^module \. exports = ({NAME})")))
    )
    rows = stmts.select(*KEY, "stmt", spec.alias("spec"), F.explode(named).alias("b"))
    return rows.select(*KEY, F.col("b.name").alias("exported"), F.col("b.imported").alias("local"), "spec", F.col("stmt").alias("ord"))


def declarations(stmts: DataFrame) -> DataFrame:
    """repo, path, name, kind (function, class, receiver, alias or var), other (the name that an alias stands for), line."""
    head = F.col("head")
    group = lambda regex, i=1: F.regexp_extract("head", regex, i)
    function, klass, var = (rf"^(?:export )?(?:default )?{x}({NAME})" for x in (r"(?:async )?function (?:\* )?", "class ", "(?:const|let|var) "))
    value = group(rf"^(?:export )?(?:const|let|var) {NAME} = (.*)$")
    alias = rf"^({NAME})(?: ;.*| (?:{'|'.join(STARTERS)}|{NAME}) .*|)$"
    bound = F.when(value.rlike(RECEIVER_FACTORY), "receiver").when(value.rlike(alias) & ~value.rlike("^(?:async|function|class|new|await) "), "alias").otherwise("var")
    name = F.coalesce(*(F.nullif(group(x), F.lit("")) for x in (function, klass, var)))
    kind = F.when(head.rlike(function), "function").when(head.rlike(klass), "class").otherwise(bound)
    rows = stmts.where(~head.rlike(rf"= require \( {STRING} \)")).select(*KEY, name.alias("name"), kind.alias("kind"), F.when(kind == "alias", F.regexp_extract(value, alias, 1)).alias("other"), "line", "stmt").where("name IS NOT NULL")
    return rows.groupBy(*KEY, "name").agg(F.min_by(F.struct("kind", "other", "line"), "stmt").alias("d")).select(*KEY, "name", "d.*")


def normal(path: Column) -> Column:
    """A path without empty, `.` and `..` parts."""
    step = lambda out, part: F.when(part.isin("", "."), out).when(part == "..", F.regexp_replace(out, "(?:^|/)[^/]+$", "")).otherwise(F.concat(out, F.when(out == "", "").otherwise("/"), part))
    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def aliases(files: DataFrame) -> DataFrame:
    """repo, prefix, target: path aliases of the configurations at the top of each repo; comments and final commas in them don't matter."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", JAVA_COMMENT, ""), r"(?m)^\s*//.*$", ""), r",\s*([}\]])", "$1")
    base = F.coalesce(F.get_json_object(bare, "$.compilerOptions.baseUrl"), F.lit("."))
    listed = F.from_json(F.get_json_object(bare, "$.compilerOptions.paths"), "map<string,array<string>>")
    rows = files.where(F.col("path").isin(*CONFIGS)).select("repo", base.alias("base"), F.explode(listed).alias("key", "to")).where("to[0] IS NOT NULL")
    cut_star = lambda c: F.regexp_replace(c, r"/?\*$", "")
    out = rows.select("repo", cut_star(F.col("key")).alias("prefix"), normal(F.concat("base", F.lit("/"), cut_star(F.col("to")[0]))).alias("target"))
    return out.where("prefix <> ''").groupBy("repo", "prefix").agg(F.min("target").alias("target"))


def spec_targets(asked: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path, spec, target for distinct (repo, path, spec) of `asked`: the first candidate path that is a file; specs of packages have none.

    A relative spec starts at its file's folder, another one at the longest alias that is a prefix of it by whole parts: its prefixes
    become rows and meet the aliases by equality.
    """
    one = asked.select(*KEY, "spec").where("spec IS NOT NULL").distinct()
    near = one.where("startswith(spec, '.')").withColumn("base", normal(F.concat(F.regexp_replace("path", "[^/]*$", ""), "spec")))
    parts = F.split("spec", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    far = one.where("NOT startswith(spec, '.')").withColumn("prefix", F.explode(prefixes)).join(known, ["repo", "prefix"])
    longest = far.groupBy(*KEY, "spec").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("a"))
    aliased = longest.withColumn("base", normal(F.concat("a.target", F.expr("substring(spec, length(a.prefix) + 1)")))).drop("a")
    stripped = F.regexp_replace("base", r"\.(?:js|mjs|cjs|jsx)$", "")
    tries = F.array(F.col("base"), *(F.concat(stripped, F.lit(e)) for e in EXTENSIONS), *(F.concat("base", F.lit(f"/index{e}")) for e in EXTENSIONS))
    there = files.select("repo", F.col("path").alias("target")).distinct()
    hit = near.unionByName(aliased).select(*KEY, "spec", F.posexplode(tries).alias("k", "target")).join(there, ["repo", "target"])
    return hit.groupBy(*KEY, "spec").agg(F.min_by("target", "k").alias("target"))


def edges(decls: DataFrame, imported: DataFrame, exported: DataFrame, targets: DataFrame) -> DataFrame:
    """One step from each name: repo, path, space (name or export), name ('*': any export not listed), to_path, to_space, to_name ('*': the same), ord, kind (of a declaration, else null)."""
    row = lambda df, space, name, to_path, to_space, to_name, ord_=F.lit(0), kind=F.lit(None).cast("string"): df.select(*KEY, F.lit(space).alias("space"), name.alias("name"), to_path.alias("to_path"), to_space.alias("to_space"), to_name.alias("to_name"), ord_.cast("int").alias("ord"), kind.alias("kind"))
    c = F.col
    local = row(decls.where("kind <> 'alias' OR other = name"), "name", c("name"), c("path"), F.lit("name"), c("name"), kind=c("kind"))
    other = row(decls.where("kind = 'alias' AND other <> name"), "name", c("name"), c("path"), F.lit("name"), c("other"))
    free = imported.join(decls.select(*KEY, "name"), [*KEY, "name"], "left_anti").join(targets, [*KEY, "spec"])
    bound = row(free.where("imported <> '*'"), "name", c("name"), c("target"), F.lit("export"), c("imported"))
    spaces = row(free.where("imported = '*'"), "name", c("name"), c("target"), F.lit("name"), F.lit("*"), kind=F.lit("namespace"))
    own = row(exported.where("spec IS NULL"), "export", c("exported"), c("path"), F.lit("name"), c("local"))
    there = exported.join(targets, [*KEY, "spec"])
    again = row(there, "export", c("exported"), c("target"), F.lit("export"), c("local"), c("ord"))
    return local.unionByName(other).unionByName(bound).unionByName(spaces).unionByName(own).unionByName(again)


def resolve(names: DataFrame, steps: DataFrame) -> DataFrame:
    """repo, path, name, to_path, to_name, kind, hops for those (repo, path, name) of `names` that lead to a declaration along `edges`.

    A name `a.b` is the export b of the module that a is a namespace of.

    Every round follows all open names one step. A listed export comes before the stars of its module, and those in their order; a place met
    again on the way there ends that way.
    """
    explicit = steps.where("NOT (space = 'export' AND name = '*')")
    stars = steps.where("space = 'export' AND name = '*'").select("repo", F.col("path").alias("at"), F.col("to_path").alias("star_path"), F.col("ord").alias("star_ord"))
    step = explicit.select("repo", F.col("path").alias("at"), "space", F.col("name").alias("now"), "to_path", "to_space", "to_name", "kind")
    place = lambda path, space, name: F.concat_ws("|", path, space, name)
    start = names.select(*KEY, "name").distinct().withColumns({"root": F.substring_index("name", ".", 1), "member": F.regexp_extract("name", r"^[^.]*\.(.*)$", 1)})
    spaces = step.where("kind = 'namespace'").select("repo", F.col("at").alias("path"), F.col("now").alias("root"), F.col("to_path").alias("space_path"))
    first = start.where("member = ''").select(*KEY, "name", F.col("path").alias("at"), F.lit("name").alias("space"), F.col("name").alias("now"))
    inner = start.where("member <> ''").join(spaces, [*KEY, "root"]).select(*KEY, "name", F.col("space_path").alias("at"), F.lit("export").alias("space"), F.col("member").alias("now"))
    open_ = cut(first.unionByName(inner).select("*", F.array().cast("array<int>").alias("rank"), F.array(place("at", "space", "now")).alias("seen")))
    done = None
    while True:
        joined = open_.join(step, ["repo", "at", "space", "now"], "left")
        ended = joined.where("kind IS NOT NULL").select(*KEY, "name", "to_path", "to_name", "kind", "rank", F.size("seen").alias("hops"))
        done = ended if done is None else done.unionByName(ended)
        moved = joined.where("to_path IS NOT NULL AND kind IS NULL").select(*KEY, "name", F.col("to_path").alias("at"), F.col("to_space").alias("space"), F.col("to_name").alias("now"), "rank", "seen")
        fanned = joined.where("to_path IS NULL AND space = 'export' AND now <> 'default'").join(stars, ["repo", "at"]).select(*KEY, "name", F.col("star_path").alias("at"), "space", "now", F.concat("rank", F.array("star_ord")).alias("rank"), "seen")
        new = place("at", "space", "now")
        open_ = cut(moved.unionByName(fanned).where(~F.array_contains("seen", new)).withColumn("seen", F.concat("seen", F.array(new))))
        if open_.isEmpty():
            break
    best = done.groupBy(*KEY, "name").agg(F.min(F.struct("rank", "hops", "to_path", "to_name", "kind")).alias("b"))
    return best.select(*KEY, "name", "b.to_path", "b.to_name", "b.kind", "b.hops")


def router_calls(toks: DataFrame, decls: DataFrame) -> DataFrame:
    """repo, path, n, line, receiver, verb (`VERBS` or use), at (the first argument if it is a string, else null), args (the others' names, in order).

    A call counts on a declared receiver or on a name like one. Of an argument its name stays: `a.b`, `f` for a call of f, `<inline>` for anything else.
    """
    order = Window.partitionBy(*KEY).orderBy("n")
    code = toks.withColumn("i", F.row_number().over(order))
    by_place = Window.partitionBy(*KEY).orderBy("i")
    ahead = lambda k: F.lead("token", k).over(by_place)
    brackets = code.where(F.col("token").isin("(", "[", "{", ")", "]", "}")).withColumn("end", F.lead("i").over(Window.partitionBy(*KEY, "depth").orderBy("i")))
    shape = F.col("token").rlike(f"^{NAME}$") & (F.coalesce(F.lag("token").over(by_place), F.lit("")) != ".") & (ahead(1) == ".") & ahead(2).isin(*VERBS, "use") & (ahead(3) == "(")
    found = code.withColumns({"hit": shape, "verb": ahead(2)}).where("hit").select(*KEY, "n", "line", F.col("token").alias("receiver"), "verb", (F.col("i") + 3).alias("i"))
    known = decls.where("kind = 'receiver'").select(*KEY, F.col("name").alias("receiver"), F.lit(True).alias("declared"))
    calls = found.join(known, [*KEY, "receiver"], "left").where(F.coalesce("declared", F.col("receiver").rlike(RECEIVER_NAME))).drop("declared")
    spans = calls.join(brackets.select(*KEY, "i", "end", F.col("depth").alias("level")), [*KEY, "i"])
    inner = code.join(spans.select(*KEY, "i", F.struct(F.col("n").alias("call"), F.col("i").alias("open"), "end", "level").alias("s")), [*KEY, "i"], "left")
    inner = inner.withColumn("s", F.last("s", ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    top = inner.where("s IS NOT NULL AND i > s.open AND i < s.end AND depth = s.level + 1")
    numbered = top.withColumn("arg", F.sum((F.col("token") == ",").cast("int")).over(Window.partitionBy(*KEY, "s.call").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("token <> ','")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ")
    each = numbered.groupBy(*KEY, F.col("s.call").alias("n"), "arg").agg(text.alias("text"))
    is_text = F.col("text").rlike(rf"^{STRING}$")
    chain = rf"^({NAME}(?: \. {NAME})*+)(?: \(.*)?$"
    name = F.when(F.col("text").rlike(chain) & ~F.col("text").rlike(r"^(?:async|function|new) "), F.replace(F.regexp_extract("text", chain, 1), F.lit(" "), F.lit(""))).otherwise("<inline>")
    first = F.max(F.when((F.col("arg") == 0) & is_text, F.regexp_extract("text", STRING, 1)))
    rest = F.transform(F.array_sort(F.collect_list(F.when((F.col("arg") > 0) | ~is_text, F.struct("arg", name.alias("name"))))), lambda x: x["name"])
    args = each.groupBy(*KEY, "n").agg(first.alias("at"), rest.alias("args"))
    return calls.drop("i").join(args, [*KEY, "n"]).where("(verb = 'use' OR at IS NOT NULL) AND size(args) > 0")


def read(files: DataFrame, calls: bool = True) -> dict[str, DataFrame]:
    """All tables of `files` (repo, path, content), tokens written once: decls, imports, exports, targets, steps, and calls if asked for."""
    toks = cut(tokens(files)) if calls else tokens(files)
    stmts = cut(statements(toks))
    decls, imported, exported = declarations(stmts), imports(stmts), exports(stmts)
    targets = cut(spec_targets(imported.select(*KEY, "spec").unionByName(exported.select(*KEY, "spec")), files, aliases(files)))
    found = {"decls": decls, "imports": imported, "exports": exported, "targets": targets, "steps": cut(edges(decls, imported, exported, targets))}
    return found | ({"calls": cut(router_calls(toks, decls))} if calls else {})


def route_map(files: DataFrame) -> DataFrame:
    """One row per route and way to it: repo, file, line, method, path, receiver, through, guards (level:name, in order), handler, handler_at.

    A use whose argument is a receiver mounts it; what stands before it in that use, and what its parent used earlier for that prefix, guards the mount.
    Guards of mounts come first, from the top, then those that the router used before the route for its path, then the route's own.
    """
    m = read(files)
    calls = m["calls"]
    used = calls.select(*KEY, F.explode(F.concat(F.array("receiver"), "args")).alias("name")).where("name <> '<inline>'")
    found = cut(resolve(used, m["steps"]))
    key = lambda path, name: F.concat_ws("#", F.concat_ws(":", "repo", path), name)
    own = found.where("kind = 'receiver'").select(*KEY, F.col("name").alias("receiver"), key("to_path", "to_name").alias("node"))
    placed = calls.join(own, [*KEY, "receiver"], "left").withColumn("node", F.coalesce("node", key("path", "receiver")))
    arg = placed.where("verb = 'use'").select(*KEY, "n", "line", "node", "at", F.posexplode("args").alias("k", "name"))
    arg = arg.join(own.select(*KEY, F.col("receiver").alias("name"), F.col("node").alias("child")), [*KEY, "name"], "left")
    of_call = Window.partitionBy(*KEY, "n")
    arg = cut(arg.withColumns({"mounts": F.max(F.col("child").isNotNull()).over(of_call), "before": F.collect_list(F.when(F.col("child").isNull(), F.col("name"))).over(of_call.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))}))
    uses = arg.where("NOT mounts").select(F.col("node").alias("receiver"), "line", "n", "k", F.col("at").alias("prefix"), F.col("name").alias("guard"))
    mounts = arg.where("child IS NOT NULL").select(F.col("node").alias("parent"), "child", F.coalesce("at", F.lit("")).alias("prefix"), "line", "before", F.concat_ws(":", *KEY, "n", "k").alias("mount"))
    listed = lambda level, c: F.transform(c, lambda x: F.concat(F.lit(level + ":"), x["guard"]))
    gathered = F.array_sort(F.collect_list(F.when(F.col("guard").isNotNull(), F.struct("use_line", "use_n", "use_k", "guard"))))
    asked = uses.select("receiver", F.col("line").alias("use_line"), F.col("n").alias("use_n"), F.col("k").alias("use_k"), F.col("prefix").alias("use_prefix"), "guard")
    covers = lambda path: (F.col("use_line") < F.col("line")) & (F.col("use_prefix").isNull() | routes.prefix_covers(F.col("use_prefix"), path))
    above = mounts.join(asked.withColumnRenamed("receiver", "parent"), "parent", "left").withColumn("guard", F.when(covers(F.col("prefix")), F.col("guard")))
    guarded = above.groupBy("mount", "parent", "child", "prefix", "before").agg(gathered.alias("g"))
    chains = routes.chains(guarded.select("parent", "child", "prefix", F.concat(listed("mount", F.col("g")), F.transform("before", lambda x: F.concat(F.lit("mount:"), x))).alias("guards")))
    rows = placed.where("verb <> 'use'").select(*KEY, "n", "line", F.col("verb").alias("method"), "at", F.col("receiver").alias("local"), F.col("node").alias("receiver"), "args")
    near = rows.join(asked, "receiver", "left").withColumn("guard", F.when(covers(F.col("at")), F.col("guard")))
    near = near.groupBy(*KEY, "n", "line", "method", "at", "local", "receiver", "args").agg(listed("router", gathered).alias("g"))
    full = near.join(chains.select("receiver", F.col("prefix").alias("above"), "through", F.col("guards").alias("outer")), "receiver", "left")
    last = F.element_at("args", -1)
    none = F.array().cast("array<string>")
    guards = F.concat(F.coalesce("outer", none), "g", F.transform(F.slice("args", 1, F.size("args") - 1), lambda x: F.concat(F.lit("route:"), x)))
    at = found.where("kind = 'function'").select(*KEY, F.col("name").alias("handler"), F.concat_ws("#", "to_path", "to_name").alias("handler_at"))
    out = full.select("repo", "path", "line", "method", routes.join_path(F.coalesce("above", F.lit("")), F.col("at")).alias("full_path"), F.col("local").alias("receiver"), F.coalesce("through", none).alias("through"), guards.alias("guards"), last.alias("handler"))
    return out.join(at, [*KEY, "handler"], "left").select("repo", F.col("path").alias("file"), "line", "method", F.col("full_path").alias("path"), "receiver", "through", "guards", "handler", "handler_at")


#: The order of routes in a map.
ROUTE_ORDER = ("file", "line", "path", "method", "through", "handler")


def serialised(found: DataFrame, files: DataFrame) -> DataFrame:
    """repo, n_routes, n_unguarded, map, map_sha256: each repo's routes as JSON in `ROUTE_ORDER`, equal for equal routes however they are dealt; repos without routes have an empty list."""
    fields = [c for c in found.columns if c != "repo" and c not in ROUTE_ORDER]
    route = F.struct(*ROUTE_ORDER, *fields)
    per = found.groupBy("repo").agg(F.count("*").alias("n_routes"), F.count_if(F.size("guards") == 0).alias("n_unguarded"), F.array_sort(F.collect_list(route)).alias("routes"))
    every = files.select("repo").distinct().join(per, "repo", "left")
    routed = every.select("repo", F.coalesce("n_routes", F.lit(0)).alias("n_routes"), F.coalesce("n_unguarded", F.lit(0)).alias("n_unguarded"), F.concat(F.lit('{"routes":'), F.coalesce(F.to_json("routes"), F.lit("[]")), F.lit("}\n")).alias("map"))
    return routed.withColumn("map_sha256", F.sha2("map", 256))
