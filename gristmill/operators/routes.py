"""Route graphs over edge tables: mount chains, guards, layout ancestors and span tests.

These operators start from tables of receivers, mounts, routes and uses; `modules` reads such from sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import cut

# Fixed values.
LAYOUTS = ("_layout.tsx", "_layout.ts", "_layout.jsx", "_layout.js")
CALL_DEPTH = 3
# End of fixed values.


def join_path(prefix: Column, path: Column) -> Column:
    """Mount prefix and path joined with single slashes; a dynamic part makes the whole dynamic."""
    both = F.regexp_replace(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")), "/+", "/")
    trimmed = F.when(F.length(both) > 1, F.regexp_replace(both, "/$", "")).otherwise(both)
    return F.when((prefix == "<dynamic>") | (path == "<dynamic>"), "<dynamic>").otherwise(trimmed)


def prefix_covers(prefix: Column, path: Column) -> Column:
    bare = F.regexp_replace(prefix, "/+$", "")
    return prefix.isin("/", "") | (path == "<dynamic>") | (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def chains(mounts: DataFrame) -> DataFrame:
    """receiver, prefix, through from mounts (parent, child, prefix): every way from a receiver up to a root.

    Each round adds one parent to the chains that still have one, so it runs as deep as the deepest
    mount. A receiver met again ends its chain. Receivers without mounts are not listed (prefix "").
    If mounts have guards (an array), chains have those of their mounts, from the top down.
    """
    guarded = "guards" in mounts.columns
    carried = ["guards"] if guarded else []
    up = mounts.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"), F.col("prefix").alias("_prefix"), *([F.col("guards").alias("_guards")] if guarded else []))
    open_ = cut(mounts.select(F.col("child").alias("receiver"), F.col("parent").alias("top"), F.col("prefix").alias("prefix"), F.array("parent").alias("through"), F.array("child", "parent").alias("seen"), *carried).withColumn("looped", F.col("top") == F.col("receiver")))
    ends = ["receiver", "prefix", "through", *carried]
    done = None
    while True:
        joined = open_.where("NOT looped").join(up, F.col("top") == F.col("_child"), "left")
        ended = joined.where("_parent IS NULL").select(*ends).unionByName(open_.where("looped").select(*ends))
        done = ended if done is None else done.unionByName(ended)
        above = [F.concat("_guards", "guards").alias("guards")] if guarded else []
        more = joined.where("_parent IS NOT NULL").select("receiver", F.col("_parent").alias("top"), join_path(F.col("_prefix"), F.col("prefix")).alias("prefix"), F.concat(F.array("_parent"), "through").alias("through"), F.concat("seen", F.array("_parent")).alias("seen"), *above, F.array_contains("seen", F.col("_parent")).alias("looped"))
        open_ = cut(more)
        if open_.isEmpty():
            return done


def mounted_routes(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """`routes` (receiver, path, ...) once per mount chain, with full_path and through."""
    c = chains(mounts)
    joined = routes.join(c.withColumnRenamed("prefix", "_prefix"), "receiver", "left")
    return joined.withColumn("full_path", join_path(F.coalesce("_prefix", F.lit("")), F.col("path"))).withColumn("through", F.coalesce("through", F.array().cast("array<string>"))).drop("_prefix")


def router_guards(routes: DataFrame, uses: DataFrame) -> DataFrame:
    """route_id, guard, line: guards used on the route's receiver before it whose prefix covers its path."""
    u = uses.select("receiver", F.col("line").alias("use_line"), F.col("prefix").alias("use_prefix"), "guard")
    hit = (F.col("use_line") < F.col("line")) & (F.col("use_prefix").isNull() | prefix_covers(F.col("use_prefix"), F.col("path")))
    return routes.join(u, "receiver").where(hit).select("route_id", "guard", F.col("use_line").alias("line"))


def called(calls: DataFrame, starts: DataFrame, depth: int = CALL_DEPTH) -> DataFrame:
    """route_id, symbol, depth: symbols reached from a route's handler within `depth` calls, each at its first depth."""
    edge = calls.select(F.col("caller").alias("symbol"), "callee")
    front = starts.select("route_id", F.col("handler").alias("symbol"))
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = front.join(edge, "symbol").select("route_id", F.col("callee").alias("symbol")).distinct().join(seen, ["route_id", "symbol"], "left_anti")
        front = cut(new)
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def layout_guards(files: DataFrame) -> DataFrame:
    """route, layout, level, proven for every route file below routes/ and each ancestor layout (path column of `files`).

    Of each folder the first existing layout name counts. Coverage is proven while all folders up
    to it end in +, none opts out with a trailing _, and the file's own first part does not.
    """
    norm = F.regexp_replace(F.translate("path", "\\", "/"), "/+", "/")
    routes = files.select(norm.alias("route")).where(F.col("route").rlike("(?:^|/)routes/")).distinct()
    parts = F.split("route", "/")
    last_root = F.size(parts) - F.array_position(F.reverse(F.slice(parts, 1, F.size(parts) - 1)), "routes")
    routes = routes.withColumn("parts", parts).withColumn("root", last_root.cast("int"))  # 1-based place of the last routes/ folder
    own = F.get(F.split(F.element_at("parts", -1), r"\."), F.lit(0)).endswith("_")
    level = F.explode(F.sequence(F.size("parts") - 1, F.col("root"), F.lit(-1)))
    dirs = routes.withColumn("broken_file", own).withColumn("level", level)
    below = F.slice("parts", F.col("level") + 1, F.size("parts") - 1 - F.col("level"))
    broken = F.col("broken_file") | F.exists(below, lambda p: ~p.endswith("+") | p.endswith("_+"))
    dirs = dirs.withColumn("proven", ~broken).withColumn("dir", F.array_join(F.slice("parts", 1, F.col("level")), "/"))
    names = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(LAYOUTS)))
    candidates = dirs.withColumn("c", F.explode(names)).withColumn("layout", F.concat("dir", F.lit("/"), F.col("c.name")))
    there = candidates.where("layout <> route").join(files.select(norm.alias("layout")).distinct(), "layout", "left_semi")
    first = there.groupBy("route", "level", "proven").agg(F.min_by("layout", "c.ord").alias("layout"))
    return first.select("route", "layout", "level", "proven")


def span_scores(nodes: DataFrame, windows: DataFrame, hunks: DataFrame) -> DataFrame:
    """Per route of nodes (route_id, kind, path, start, end): c1 if a window (path, first, last) meets a node, c2 and kinds if a node holds a hunk."""
    w = windows.select("path", F.col("first").alias("wf"), F.col("last").alias("wl"))
    h = hunks.select("path", F.col("first").alias("hf"), F.col("last").alias("hl"))
    c1 = nodes.join(w, "path").where("wf <= end AND start <= wl").select("route_id").distinct().withColumn("c1", F.lit(True))
    c2 = nodes.join(h, "path").where("start <= hf AND hl <= end").groupBy("route_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    out = nodes.select("route_id").distinct().join(c1, "route_id", "left").join(c2, "route_id", "left")
    return out.select("route_id", F.coalesce("c1", F.lit(False)).alias("c1"), F.col("kinds").isNotNull().alias("c2"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


def digest(files: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: files, parsed, routes, routes without guard and without data access."""
    f = files.select(F.lit(1).alias("file"), F.col("parsed").cast("int").alias("ok"), F.lit(0).alias("route"), F.lit(0).alias("bare"), F.lit(0).alias("idle"))
    r = routes.select(F.lit(0).alias("file"), F.lit(0).alias("ok"), F.lit(1).alias("route"), (F.col("guards") == 0).cast("int").alias("bare"), (F.col("data_accesses") == 0).cast("int").alias("idle"))
    return f.unionByName(r).agg(F.sum("file").alias("files"), F.sum("ok").alias("parsed"), F.sum("route").alias("routes"), F.sum("bare").alias("no_guard"), F.sum("idle").alias("no_data_access"))
