"""Scan reports that state their coverage, so that a clean scan and a blind one never look alike.

Results of a scan are rows of its files: (scan_id, path, calls, calls_failed, aborted, detectors_failed), where `aborted`
is null or says why the file was not read, and `detectors_failed` lists the detectors that failed on it. The document
of a scan is one row; scans are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities that a report counts by name.
COUNTED = ("critical", "high", "medium")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def coverage(results: DataFrame) -> DataFrame:
    """Per scan its files and calls, each way in which coverage was lost as a count of its own, `status` (full, degraded, blind) and `causes` in words.

    Blind is a scan none of whose files was read, or all of whose calls failed.
    """
    lost = F.coalesce(F.size("detectors_failed"), F.lit(0))
    g = results.groupBy("scan_id").agg(
        F.count("*").alias("files"), F.count("aborted").alias("aborted"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("calls_failed"), F.lit(0)).alias("failed"), F.sum(F.greatest(lost, F.lit(0))).alias("detectors")
    )
    files, aborted, calls, failed, detectors = (F.col(c) for c in ("files", "aborted", "calls", "failed", "detectors"))
    blind = (aborted == files) | ((failed > 0) & (failed >= calls))
    status = F.when(aborted + failed + detectors == 0, "full").when(blind, "blind").otherwise("degraded")
    causes = F.concat_ws(
        "; ", F.when(failed > 0, _text(failed, " of ", calls, " calls failed")), F.when(aborted > 0, _text(aborted, " of ", files, " files were not analysed")), F.when(detectors > 0, _text(detectors, " detector runs failed"))
    )
    return g.withColumns({"status": status, "causes": causes})


def gaps(results: DataFrame) -> DataFrame:
    """scan_id, path, line: every file that can't be read as analysed and clean, by name, and what went wrong; an aborted file has nothing more to tell."""
    named = lambda *what: _text("- `", F.col("path"), "`: ", *what)
    calls = F.when(F.col("calls_failed") > 0, named(F.col("calls_failed"), " failed calls"))
    detectors = F.transform(F.coalesce("detectors_failed", F.array().cast("array<string>")), lambda d: named("detector ", d, " failed"))
    lines = F.when(F.col("aborted").isNotNull(), F.array(named("not analysed, ", F.col("aborted")))).otherwise(F.concat(F.array_compact(F.array(calls)), detectors))
    return results.where("path IS NOT NULL").select("scan_id", "path", F.array_join(lines, "\n").alias("line")).where("line <> ''")


def scan_report(findings: DataFrame, results: DataFrame) -> DataFrame:
    """scan_id, status, markdown: counts, coverage, every coverage gap, then the findings (scan_id, path, start_line, type, severity, message) by file. Scans without findings have a report too."""
    item = _text("- **", F.col("severity"), "** `", F.col("type"), "` line ", F.col("start_line"), ": ", F.col("message"))
    files = findings.withColumn("_i", item).groupBy("scan_id", "path").agg(F.sort_array(F.collect_list(F.struct("start_line", "type", "_i"))).alias("_is"), *(F.count_if(F.col("severity") == s).alias(f"_{s}") for s in COUNTED))
    part = _text("## ", F.col("path"), "\n\n", F.array_join(F.transform("_is", lambda x: x["_i"]), "\n"), "\n")
    found = files.select("*", F.struct("path", part.alias("text")).alias("_p")).groupBy("scan_id").agg(F.sort_array(F.collect_list("_p")).alias("_ps"), F.sum(F.size("_is")).alias("_n"), *(F.sum(f"_{s}").alias(f"_{s}") for s in COUNTED))
    lost = gaps(results).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("_gaps"))
    g = coverage(results).join(found, "scan_id", "left").join(lost, "scan_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    warning = F.when(F.col("status") == "blind", "**Blind scan.** It says nothing about these files: ").when(F.col("status") == "degraded", "**Degraded coverage, not a clean scan.** Files under coverage gaps may hold more: ")
    head = _text(
        "# Scan report\n\n", F.when(warning.isNotNull(), _text("> ", warning, F.col("causes"), ".\n\n")).otherwise(""), "- Files: ", F.col("files"), "\n- Files analysed: ", F.col("files") - F.col("aborted"), "\n- Files with findings: ", n(F.when(F.col("_ps").isNotNull(), F.size("_ps"))),
        "\n- Findings: ", n(F.col("_n")), "\n- Severity: ", F.concat_ws(", ", *(_text(f"{s}=", n(F.col(f"_{s}"))) for s in COUNTED)), "\n- Coverage: ", F.col("status"), ", ", F.col("calls") - F.col("failed"), " of ", F.col("calls"), " calls succeeded\n",
    )
    section = F.when(F.col("_gaps").isNotNull(), _text("\n## Coverage gaps\n\n", F.array_join(F.transform("_gaps", lambda x: x["line"]), "\n"), "\n")).otherwise("")
    body = F.when(F.col("_ps").isNotNull(), _text("\n", F.array_join(F.transform("_ps", lambda x: x["text"]), "\n"))).otherwise("")
    return g.select("scan_id", "status", F.concat(head, section, body).alias("markdown"))
