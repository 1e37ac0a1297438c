"""Readers: directories, diffs, recordings, scanner output, manifests and fixtures as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.files import SCANNED, walk

VERDICT = "struct<pairIndex:int,isVulnerable:boolean,confidence:string,reasoning:string,suggestedFix:string,callerAuth:string,operationClass:string>"
RECORDING = "key string, meta struct<detectorId:string,model:string,sourceFixture:string,expectedFlagged:boolean>, response struct<toolInput:string,text:string>"
SCANNED_ITEM = "struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,metadata:string,lines:string>>"
SCANNER = f"struct<results:array<{SCANNED_ITEM}>,findings:array<{SCANNED_ITEM}>>"
ASSUMED = r"\A// ASSUMED-PATH:[ \t]*([^\r\n]*)\r?\n?"


def directory(spark: SparkSession, root: str, extensions: tuple = SCANNED, ignore_file: str = "") -> DataFrame:
    """path (relative) and content of the files of a tree; extensions prune the listing, folders and ignore rules the rows."""
    pattern = "*.{" + ",".join(extensions) + "}"
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.expr("_metadata.file_path"), "^[a-z]+:/+", "/"), "^" + "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in base.split(":", 1)[-1].replace("//", "/")) + "/", "")
    return walk(read.select(path.alias("path"), F.col("value").alias("content")), extensions, ignore_file)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """request_key, pair_index, place and verdict columns of recorded verdicts: a list or a single flat one per file."""
    raw = spark.read.schema(RECORDING).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    many = F.from_json(F.get_json_object("response.toolInput", "$.verdicts"), f"array<{VERDICT}>")
    one = F.array(F.from_json("response.toolInput", VERDICT))
    rows = raw.select(F.col("key").alias("request_key"), "meta.detectorId", F.posexplode(F.coalesce(many, one)).alias("place", "v"))
    return rows.select("request_key", F.coalesce("v.pairIndex", F.lit(0)).alias("pair_index"), "place", F.col("detectorId").alias("family"), F.col("v.isVulnerable").alias("is_vulnerable"), F.col("v.confidence").alias("confidence"), F.col("v.reasoning").alias("reasoning"), F.col("v.suggestedFix").alias("suggested_fix"), F.col("v.callerAuth").alias("caller_auth"), F.col("v.operationClass").alias("operation_class"))


def missing_recordings(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests without a recording: a replay with any of these has failed."""
    return asked.join(recorded.select("request_key").distinct(), "request_key", "left_anti")


def replayed(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """`asked` with its recorded answers; a request without one fails the job that reads it, naming the key, and never counts as answered."""
    answers = recorded.withColumn("_recorded", F.lit(True))
    joined = asked.join(answers, "request_key", "left")
    known = F.when(F.col("_recorded"), F.col("request_key")).otherwise(F.raise_error(F.concat(F.lit("no recording of "), F.coalesce("request_key", F.lit("a request without a key")))))
    return joined.withColumn("request_key", known.cast(asked.schema["request_key"].dataType)).drop("_recorded")


def scanner_results(payloads: DataFrame) -> DataFrame:
    """`payloads` (id, json) exploded to rule, path, lines, message and metadata; `valid` needs results or findings, and both are read."""
    p = payloads.withColumn("_p", F.from_json("json", SCANNER))
    valid = F.col("_p.results").isNotNull() | F.col("_p.findings").isNotNull()
    none = F.array().cast(f"array<{SCANNED_ITEM}>")
    items = F.concat(F.coalesce("_p.results", none), F.coalesce("_p.findings", none))
    rows = p.withColumn("valid", F.coalesce(valid, F.lit(False))).select("id", "valid", F.explode_outer(items).alias("r"))
    return rows.select("id", "valid", F.col("r.check_id").alias("rule"), F.col("r.path").alias("path"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.col("r.extra.message").alias("message"), F.col("r.extra.metadata").alias("metadata"), F.col("r.extra.lines").alias("code"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated manifest with a header and # comments."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("header", "true").option("enforceSchema", "false").csv(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Heterogeneous log lines (start, case, end) under one schema."""
    return spark.read.schema("at string, event string, `case` string, version string, started timestamp, ended timestamp, exit int, attempted int, failed int, invocationCostUsd double, cumulativeCostUsd double").json(path)


def assumed_path(path: Column, content: Column) -> tuple[Column, Column]:
    """(path, content) of a fixture: a first line `// ASSUMED-PATH: p` overrides the path and is stripped."""
    given = F.trim(F.regexp_extract(content, ASSUMED, 1))
    return F.when(given != "", given).otherwise(path), F.regexp_replace(content, ASSUMED, "")


def with_sidecars(files: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """`files` (path, content) with their companions: a map kind -> content of files named path + suffix."""
    out = files
    kind = F.lit(None).cast("string")
    base = F.lit(None).cast("string")
    for suffix, name in suffixes.items():
        hit = F.col("path").endswith(suffix)
        kind, base = F.when(hit, name).otherwise(kind), F.when(hit, F.expr(f"left(path, length(path) - {len(suffix)})")).otherwise(base)
    tagged = out.withColumn("_kind", kind).withColumn("_base", base)
    side = tagged.where("_kind IS NOT NULL").groupBy(F.col("_base").alias("path")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_kind", "content")))).alias("sidecars"))
    return tagged.where("_kind IS NULL").drop("_kind", "_base").join(side, "path", "left")


def commit_log(lines: DataFrame) -> DataFrame:
    """commit, path from (text): blocks that start with `@@sha` and list files; malformed shas and quoted paths are flagged."""
    blocks = lines.select(F.explode(F.split("text", r"(?m)^@@", -1)).alias("block")).where(F.trim("block") != "")
    rows = blocks.select(F.trim(F.get(F.split("block", r"\r?\n", -1), F.lit(0))).alias("commit"), F.explode(F.slice(F.split("block", r"\r?\n", -1), 2, 1 << 30)).alias("path")).where("trim(path) <> ''")
    return rows.withColumn("bad_sha", ~F.col("commit").rlike(r"\A[0-9a-f]{40}\z")).withColumn("quoted", F.col("path").startswith('"'))
