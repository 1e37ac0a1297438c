"""Unified diffs as tables: added lines with their target line numbers, changed lines, parent-side hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
PARENT = r"^@@ -([0-9]+)(?:,([0-9]+))? \+[0-9]+(?:,[0-9]+)? @@"
FROM_START = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def _lines(diffs: DataFrame) -> DataFrame:
    """scan_id, part, pos, line, kind, hunk, start, offset: one row per line of each file part.

    kind: path (`+++ b/`), hunk (`@@`), plus, minus, note (backslash), context, or before (no hunk yet).
    hunk numbers the headers; offset counts the lines since the header that the target file has, too.
    """
    parts = diffs.select("scan_id", F.posexplode(F.split("diff", r"(?m)^diff --git ", -1)).alias("part", "body")).where(F.trim("body") != "")
    lines = parts.select("scan_id", "part", F.posexplode(F.split("body", r"\r?\n", -1)).alias("pos", "line"))
    part = Window.partitionBy("scan_id", "part").orderBy("pos")
    rows = lines.withColumn("hunk", F.sum(F.col("line").startswith("@@").cast("int")).over(part.rowsBetween(*FROM_START)))
    line = F.col("line")
    kind = (
        F.when(line.startswith("+++ b/"), "path")
        .when(line.startswith("@@"), "hunk")
        .when(F.col("hunk") == 0, "before")
        .when(line.startswith("+") & ~line.startswith("+++"), "plus")
        .when(line.startswith("-"), "minus")
        .when(line.startswith("\\"), "note")
        .otherwise("context")
    )
    start = F.when(line.rlike(HUNK), F.regexp_extract(line, HUNK, 1).cast("int"))
    rows = rows.withColumn("kind", kind).withColumn("start", start)
    own = Window.partitionBy("scan_id", "part", "hunk").orderBy("pos")
    moves = F.col("kind").isin("plus", "context").cast("int")
    return rows.withColumn("offset", F.coalesce(F.sum(moves).over(own.rowsBetween(*BEFORE)), F.lit(0)).cast("int"))


def _bases(rows: DataFrame) -> DataFrame:
    """scan_id, part, hunk, base: the line on which a hunk starts.

    After a malformed header numbers run on from the last added line; the last added line before
    it is a running sum of hunk lengths since the last good hunk with additions.
    """
    hunks = rows.where("hunk > 0").groupBy("scan_id", "part", "hunk").agg(F.max("start").alias("start"), F.max(F.when(F.col("kind") == "plus", F.col("offset") + 1)).alias("length"))
    own = Window.partitionBy("scan_id", "part").orderBy("hunk")
    anchor = F.col("start").isNotNull() & F.col("length").isNotNull()
    seen = hunks.withColumn("run", F.sum(anchor.cast("int")).over(own.rowsBetween(*FROM_START)))
    run = Window.partitionBy("scan_id", "part", "run").orderBy("hunk").rowsBetween(*FROM_START)
    first = F.coalesce(F.first(F.when(anchor, F.col("start"))).over(run), F.lit(1))
    added = F.when(anchor | F.col("start").isNull(), F.coalesce("length", F.lit(0))).otherwise(0)
    seen = seen.withColumn("next", first + F.sum(added).over(run))
    return seen.select("scan_id", "part", "hunk", F.coalesce("start", F.lag("next", 1, 1).over(own)).cast("int").alias("base"))


def _paths(rows: DataFrame) -> DataFrame:
    """The last target path of each part."""
    named = rows.where("kind = 'path'")
    return named.groupBy("scan_id", "part").agg(F.max_by(F.trim(F.substring("line", 7, 1 << 20)), "pos").alias("path"))


def parse(diffs: DataFrame) -> DataFrame:
    """scan_id, part, path, content, line_map from (scan_id, diff): added lines of each part and where they stand.

    Parts without a path or without additions are dropped. A part is grouped as one row by nature.
    """
    rows = _lines(diffs)
    added = rows.where("kind = 'plus'").join(_bases(rows), ["scan_id", "part", "hunk"])
    line = F.struct("pos", F.substring("line", 2, 1 << 30).alias("text"), (F.col("base") + F.col("offset")).alias("at"))
    files = added.groupBy("scan_id", "part").agg(F.array_sort(F.collect_list(line)).alias("a")).join(_paths(rows), ["scan_id", "part"])
    return files.select("scan_id", "part", "path", F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("content"), F.transform("a", lambda x: x["at"]).alias("line_map"))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """scan_id, part, path, changed (sorted lines), has_added: added lines, and one anchor line per run of deletions."""
    rows = _lines(diffs)
    part = Window.partitionBy("scan_id", "part").orderBy("pos")
    told = rows.where(F.col("kind").isin("plus", "context", "hunk", "minus")).withColumn("last", F.lag("kind", 1, "").over(part))
    start = F.first("start").over(Window.partitionBy("scan_id", "part", "hunk").orderBy("pos").rowsBetween(*FROM_START))
    at = F.coalesce(start, F.lit(1)) + F.col("offset")  # here a malformed header starts again at 1
    told = told.withColumn("n", F.when(F.col("kind") == "minus", F.greatest(at, F.lit(1))).otherwise(at))
    hit = told.where("kind = 'plus' OR (kind = 'minus' AND last <> 'minus')")
    lines = hit.groupBy("scan_id", "part").agg(F.array_sort(F.collect_set("n")).alias("changed"), F.max(F.col("kind") == "plus").alias("has_added"))
    return lines.join(_paths(rows), ["scan_id", "part"]).select("scan_id", "part", "path", "changed", "has_added")


def parent_hunks(diffs: DataFrame) -> DataFrame:
    """scan_id, pos, path, first, last: parent-side ranges; a missing count is 1, a pure insertion spans two lines."""
    lines = diffs.select("scan_id", F.posexplode(F.split("diff", r"\r?\n", -1)).alias("pos", "line"))
    name = F.trim(F.substring("line", 5, 1 << 20))
    own = Window.partitionBy("scan_id").orderBy("pos").rowsBetween(*FROM_START)
    rows = lines.withColumn("path", F.last(F.when(F.col("line").startswith("--- "), F.regexp_replace(name, "^a/", "")), ignorenulls=True).over(own))
    start, count = F.regexp_extract("line", PARENT, 1).cast("int"), F.regexp_extract("line", PARENT, 2)
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    hunks = rows.where(F.col("line").rlike(PARENT) & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    return hunks.select("scan_id", "pos", "path", F.when(n > 0, start).otherwise(F.greatest(F.lit(1), start)).alias("first"), F.when(n > 0, start + n - 1).otherwise(start + 1).alias("last"))


def synthetic(path: Column, content: Column) -> Column:
    """A diff that adds a whole file: trailing blank lines trimmed, one hunk from line 1."""
    body = F.regexp_replace(content, r"(?:\r?\n[ \t]*)+\z", "")
    lines = F.split(body, r"\r?\n", -1)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))


def remap(line: Column, line_map: Column) -> Column:
    """The target line of a content line; out of range keeps it."""
    return F.coalesce(F.try_element_at(line_map, F.greatest(line, F.lit(1))), line)
