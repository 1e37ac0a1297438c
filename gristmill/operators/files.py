"""Filters over files: what is scanned, and why the rest is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.catalog import Pattern
from gristmill.functions.globs import ignore_regexes
from gristmill.functions.text import extension, language_of, normal_path
from gristmill.runtime import cut

# Fixed values.
SCANNED = ("ts", "tsx", "js", "jsx", "py", "go")
SKIPPED_DIRS = (
    "node_modules", ".git", ".next", "dist", "build", "__pycache__", ".venv", ".turbo", ".cache", ".nx", ".parcel-cache", ".yarn", ".pnpm-store", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".coverage", "coverage", ".gradle", "bower_components", ".idea", ".vscode", ".fleet", ".claude", "venv", "target", "vendor", "out",
)
SKIP_SEGMENT = r"(?i)(?:^|/)(?:test|tests|__tests__|spec|fixtures|examples?|scripts?|dev-tools|migrations?|seed|seeds|demo|e2e|e2e-[a-z0-9-]+|api[_-]tests|app-tests)(?:/|$)"
SKIP_FILE = r"(?i)(?:\.(?:test|spec)\.[a-z]+|_test\.go)$"
SERVER_ONLY = r"(?m)^\s*import\s+[\"']server-only[\"']\s*;?\s*$"
WHOLE_FILE_BYTES = 200_000
SAMPLE_OVER, SAMPLE_SIZE = 2000, 500
# End of fixed values.


def skipped_path(path: Column) -> Column:
    p = normal_path(path)
    return p.rlike(SKIP_SEGMENT) | p.rlike(SKIP_FILE)


def below_skipped_dir(path: Column, dirs: tuple = SKIPPED_DIRS) -> Column:
    """Whether any folder of the path (not the file itself) is never descended into."""
    folders = F.split(F.regexp_replace(normal_path(path), "/?[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*map(F.lit, dirs)))


def walk(files: DataFrame, extensions: tuple = SCANNED, ignore_file: str = "") -> DataFrame:
    """The files (path, ...) a directory scan would visit."""
    kept = files.where(extension(F.col("path")).isin(*extensions) & ~below_skipped_dir(F.col("path")))
    for rx in ignore_regexes(ignore_file)[0]:
        kept = kept.where(~normal_path(F.col("path")).rlike(rx))
    return kept


def remix_path(path: Column) -> Column:
    p = normal_path(path)
    return p.rlike(r"(?:^|/)routes/") | p.rlike(r"(?:^|/)app/root\.tsx?$")


def allowed(pattern: Pattern, path: Column) -> Column:
    """Whether a pattern may fire on a path: language list, Python, and Remix gates."""
    python = F.lower(path).endswith(".py")
    ok = F.lit(True)
    if pattern.langs:
        ok = ok & F.coalesce(language_of(path).isin(*pattern.langs), F.lit(False))
    if pattern.gate == "python":
        ok = ok & python
    elif pattern.gate == "remix":
        ok = ok & remix_path(path)
    if pattern.id in ("express_route_def", "app_router_route_def", "remix_handler_def"):
        ok = ok & ~python
    return ok


def prefilter_reason(path: Column, content: Column, hits: Column) -> Column:
    """The first filter that a file fails, null if it passes: language, path, marker, then patterns."""
    return (
        F.when(language_of(path).isNull(), "unsupported_language")
        .when(skipped_path(path), "skipped_path")
        .when(content.rlike(SERVER_ONLY), "server_only")
        .when(F.coalesce(hits, F.lit(0)) == 0, "no_pattern")
    )


def whole_files(parts: DataFrame, head: DataFrame) -> DataFrame:
    """Diff parts (path, content, has_added) with the full file where one of at most 200,000 bytes was read.

    `head`: path, content, error. A failed read or a large file keeps the part; a part without
    added lines and without a file goes. `input_error` reports failed reads.
    """
    h = head.select("path", F.col("content").alias("_full"), F.col("error").alias("_error"))
    fits = F.col("_full").isNotNull() & (F.octet_length("_full") <= WHOLE_FILE_BYTES)
    joined = parts.join(h, "path", "left").withColumn("origin", F.when(fits, "whole_file").otherwise("part"))
    joined = joined.where(fits | F.col("has_added"))
    return joined.select(*[c for c in parts.columns if c != "content"], F.when(fits, F.col("_full")).otherwise(F.col("content")).alias("content"), "origin", F.col("_error").alias("input_error"))


def systematic_sample(files: DataFrame, order: list[str], over: int = SAMPLE_OVER, size: int = SAMPLE_SIZE) -> DataFrame:
    """Every k-th row in `order` if there are more than `over`, with `step` = k; all rows otherwise.

    Row numbers come from per-partition counts of a range partitioning, not from one global window.
    """
    n = files.count()
    k = n // size if n > over else 1
    if k == 1:
        return files.withColumn("step", F.lit(1))
    return numbered(files, order).where(F.pmod(F.col("_n") - 1, F.lit(k)) == 0).drop("_n").withColumn("step", F.lit(k))


def numbered(rows: DataFrame, order: list[str], into: str = "_n") -> DataFrame:
    """`rows` with their 1-based place in `order`: numbered within range partitions and shifted by the counts before.

    The partitioned rows are written once, so that counts and numbers go by the same boundaries.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))  # one row per partition
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(into, F.col("_before") + F.col("_r")).drop("_part", "_r", "_before")
