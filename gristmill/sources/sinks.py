"""Report sinks: result logs, markdown, comments with a size guard, and table writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import clip_utf8, ellipsis, fence, snippet, table_cell
from gristmill.operators.findings import level_of, newest_per
from gristmill.runtime import cut, ship

ship("gristmill.functions.text")

# Fixed values.
COMMENT_BYTES = 58_000
DETAILED, LISTED, ERRORS = 10, 10, 5
NOTICE = "\n\n_Report shortened to fit the size limit._\n\n"
MARKER = "<!-- end of report -->"
# End of fixed values.


def result_log(findings: DataFrame, failed: Column, tool: str = "gristmill", coverage: DataFrame | None = None) -> DataFrame:
    """One row per scan_id: a SARIF 2.1.0 log with one rule per used type and one result per finding (type, path, start_line, message, severity).

    The results of a scan form one document and so one row; scans are independent. With `coverage`
    (`reports.coverage`) every scan that it names has a log, and one that lost coverage did not succeed and says why.
    """
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    print_ = F.create_map(F.lit("primary/v1"), F.concat_ws(":", "type", "path", "start_line"))
    result = F.struct(F.col("type").alias("ruleId"), level_of(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"), print_.alias("partialFingerprints"))
    g = findings.groupBy("scan_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sort_array(F.collect_list(F.struct("path", "start_line", "type", F.to_json(result).alias("json")))).alias("rs"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.transform("types", lambda t: F.struct(t.alias("id"))).alias("rules")).alias("driver"))
    note = F.lit(None).cast("string")
    if coverage is not None:
        empty = {"types": F.coalesce("types", F.array().cast("array<string>")), "rs": F.coalesce("rs", F.array().cast(g.schema["rs"].dataType))}
        g = coverage.select("scan_id", "status", "causes").join(g, "scan_id", "left").withColumns(empty)
        failed = failed | (F.col("status") != "full")
        note = F.when(F.col("status") != "full", F.concat(F.lit("Coverage lost: "), "causes"))
    notes = F.when(note.isNotNull(), F.array(F.struct(F.lit("error").alias("level"), F.struct(note.alias("text")).alias("message"))))
    head = F.to_json(F.struct(driver.alias("tool"), F.array(F.struct((~failed).alias("executionSuccessful"), notes.alias("toolExecutionNotifications"))).alias("invocations")))
    body = F.concat(F.lit('{"version":"2.1.0","runs":['), F.expr("left(_h, length(_h) - 1)"), F.lit(',"results":['), F.array_join(F.transform("rs", lambda r: r["json"]), ","), F.lit("]}]}"))
    return g.withColumn("_h", head).select("scan_id", F.size("rs").alias("results"), body.alias("sarif"))


def report_lines(findings: DataFrame) -> DataFrame:
    """Markdown per file: a heading, then one line per finding in line order, with its snippet fenced."""
    code = snippet(F.col("content"), F.col("line"))
    item = F.concat(F.lit("- **"), F.col("severity"), F.lit("** line "), F.col("line").cast("string"), F.lit(": "), table_cell(F.col("why")), F.lit("\n\n"), fence(code), F.lit("\n"), code, F.lit("\n"), fence(code))
    g = findings.withColumn("_item", item).groupBy("path").agg(F.count("*").alias("findings"), F.sort_array(F.collect_list(F.struct("line", "why", "_item"))).alias("items"))
    return g.select("path", "findings", F.concat(F.lit("### "), "path", F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["_item"]), "\n")).alias("markdown"))


@F.pandas_udf(T.StringType())
def _clipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else clip_utf8(t, COMMENT_BYTES, MARKER, NOTICE))


def error_list(errors: DataFrame) -> DataFrame:
    """scan_id and its first errors (scan_id, place, message) as a list, with a count of the rest."""
    first = newest_per(errors, ["scan_id"], ["place", "message"], ERRORS).withColumn("_l", F.concat(F.lit("- **"), ellipsis(F.col("message"), 120), F.lit("**")))
    listed = first.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_l"))).alias("_ls"))
    totals = errors.groupBy("scan_id").agg(F.count("*").alias("_n"))
    rest = F.when(F.col("_n") > ERRORS, F.concat(F.lit("\n- …and "), (F.col("_n") - ERRORS).cast("string"), F.lit(" more"))).otherwise("")
    return listed.join(totals, "scan_id").select("scan_id", F.concat(F.lit("### Errors\n\n"), F.array_join(F.transform("_ls", lambda x: x["_l"]), "\n"), rest, F.lit("\n\n")).alias("errors"))


def comments(findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One comment per scan_id: at most 10 new findings in full, 10 older ones as a list, with counts of the rest, within the byte limit.

    The first of its `errors` (scan_id, place, message) stand before the findings; a scan with errors alone has a comment too.
    """
    rank = newest_per(findings, ["scan_id", "introduced"], ["path", "start_line", "type"], max(DETAILED, LISTED))
    totals = findings.groupBy("scan_id").agg(F.count_if("introduced").alias("new"), F.count_if(~F.col("introduced")).alias("old"))
    line = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("` "), ellipsis(F.col("message"), 120))
    g = rank.withColumn("_l", line).groupBy("scan_id").agg(*(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("introduced") == flag, F.struct("rank", "_l")))), lambda x: x["_l"]), "\n").alias(n) for flag, n in ((True, "fresh"), (False, "known"))))
    more = lambda c, n: F.when(F.col(c) > n, F.concat(F.lit("\n- …and "), (F.col(c) - n).cast("string"), F.lit(" more"))).otherwise("")
    joined = g.join(totals, "scan_id").withColumn("errors", F.lit(""))
    if errors is not None:
        blank = {"new": F.coalesce("new", F.lit(0)), "old": F.coalesce("old", F.lit(0)), **{c: F.coalesce(c, F.lit("")) for c in ("fresh", "known", "errors")}}
        joined = joined.drop("errors").join(error_list(errors), "scan_id", "full").withColumns(blank)
    body = F.concat(F.lit("## Scan result\n\n"), "errors", F.col("new").cast("string"), F.lit(" new, "), F.col("old").cast("string"), F.lit(" pre-existing\n\n"), "fresh", more("new", DETAILED), F.lit("\n\n"), "known", more("old", LISTED), F.lit("\n" + MARKER))
    return joined.select("scan_id", "new", "old", _clipped(body).alias("comment"))


def append_by_month(rows: DataFrame, path: str, ts: str) -> None:
    """Appends rows to a table partitioned by month, so reads of a period list only its folders. A large month is split over tasks."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


#: The column that holds a row's part of a merged table.
PART = "_part"


def merge(rows: DataFrame, path: str, key: list[str], version: list[str], first: bool = False, parts: int = 64) -> int:
    """Merges rows into the table at `path` and says how many of its parts were written: of equal keys the one with the highest `version` stays.

    With `first` rows whose key the table has are ignored, and of equal keys among `rows` the lowest version stays. Of equal versions the
    table's own row stays, so a batch that is merged again changes nothing. The table is partitioned by a hash of the key; only parts that the rows touch are read, and overwritten after their new
    content is written to the checkpoint folder, so a job that is lost half-way leaves the old parts. `parts` must not change.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    names = rows.columns
    new = rows.select("*", part.alias(PART), F.lit(int(first)).alias("_held"))
    touched = sorted(r[0] for r in new.select(PART).distinct().collect())  # `parts` at most
    if not touched:
        return 0
    if _exists(spark, path):
        new = spark.read.parquet(path).where(F.col(PART).isin(touched)).select(*names, PART, F.lit(int(not first)).alias("_held")).unionByName(new)
    pick, order = (F.min, ["_held", *version]) if first else (F.max, [*version, "_held"])
    best = new.groupBy(PART, *key).agg(pick(F.struct(*order, F.struct(*names).alias("row"))).alias("b"))
    merged = cut(best.select("b.row.*", PART))
    merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return len(touched)


def merged_rows(spark, path: str) -> DataFrame:
    """The rows of a table that `merge` writes."""
    return spark.read.parquet(path).drop(PART)


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def merge_stream(rows: DataFrame, path: str, key: list[str], version: list[str], checkpoint: str, first: bool = False):
    """Merges every micro-batch of a stream; a batch that runs twice after a restart changes nothing the second time."""
    write = lambda batch, _: merge(batch, path, key, version, first) and None
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
