"""Findings: de-duplication, tenant settings, introduced or pre-existing, registry and report forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.globs import glob_regex
from gristmill.functions.text import severity_rank

# Fixed values.
DETECTORS = {"auth_bypass_risk": "auth-bypass", "admin_check_risk": "admin-check", "env_exposure_risk": "env-exposure", "webhook_unverified_risk": "webhook-unverified", "secrets_exposure_risk": "secrets-exposure", "idor_risk": "idor"}
SUPPRESSED = ("sql_injection_risk", "xss_risk", "command_injection_risk", "path_traversal_risk", "mass_assignment_risk")
#: type, weakness id, top-ten class
REGISTRY = [
    ("sql_injection_risk", "CWE-89", "A03:2021"), ("xss_risk", "CWE-79", "A03:2021"), ("command_injection_risk", "CWE-78", "A03:2021"), ("path_traversal_risk", "CWE-22", "A01:2021"),
    ("auth_bypass_risk", "CWE-285", "A01:2021"), ("secrets_exposure_risk", "CWE-798", "A07:2021"), ("webhook_unverified_risk", "CWE-345", "A08:2021"), ("env_exposure_risk", "CWE-200", "A01:2021"),
    ("admin_check_risk", "CWE-798", "A07:2021"), ("idor_risk", "CWE-639", "A01:2021"), ("mass_assignment_risk", "CWE-915", "A04:2021"),
]
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
BEFORE_CHANGE, AFTER_CHANGE = 5, 40
# End of fixed values.


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def detector_of(kind: Column) -> Column:
    return F.element_at(_map(DETECTORS), kind)


def level_of(severity: Column) -> Column:
    return F.element_at(_map(LEVELS), severity)


def finding_id(detector: Column, kind: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", detector, kind, path, line)


def first_wins(findings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in `order`. A minimum of structs, combined before the shuffle."""
    rest = [c for c in findings.columns if c not in key]
    first = findings.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*[F.col(c) if c in key else F.col(f"_f.`{c}`").alias(c) for c in findings.columns])


def unsuppressed(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("type").isin(*SUPPRESSED))


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether any glob fits the path."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def drop_reason(severity: Column, path: Column, kind: Column, threshold: Column, glob_hit: Column, enabled: Column) -> Column:
    """The first tenant gate that a finding fails (severity, glob, detector), null if it passes.

    `enabled` null: all detectors; empty: none; without any known id: all.
    """
    known = F.array_intersect(enabled, F.array(*map(F.lit, DETECTORS.values())))
    detector = detector_of(kind)
    off = F.when(F.size(enabled) == 0, F.lit(True)).otherwise((F.size(known) > 0) & detector.isNotNull() & ~F.array_contains(known, detector))
    return F.when(severity_rank(severity) < severity_rank(threshold), "severity").when(glob_hit, "glob").when(enabled.isNotNull() & F.coalesce(off, F.lit(False)), "detector")


def tenant_filter(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """`findings` (tenant, severity, path, type, ...) with drop_reason under (tenant, threshold, globs, enabled).

    Globs differ by tenant: they arrive as regular expressions in `globs` (see glob_regex) and are tried in turn.
    """
    s = settings.select(F.col("tenant").alias("_t"), "threshold", "globs", "enabled")
    joined = findings.join(s, F.col("tenant") == F.col("_t"), "left").drop("_t")
    hit = F.coalesce(F.exists("globs", lambda g: F.regexp_like(F.col("path"), g)), F.lit(False))
    reason = drop_reason(F.col("severity"), F.col("path"), F.col("type"), F.coalesce("threshold", F.lit("low")), hit, F.col("enabled"))
    return joined.withColumn("drop_reason", reason).drop("threshold", "globs", "enabled")


def partition_by_change(findings: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """`findings` with `introduced`: a changed line lies in [start - 5, max(start, end) + 40], or the path has no entry."""
    c = changed.select(*keys, "changed").withColumn("_known", F.lit(True))
    low, high = F.col("start_line") - BEFORE_CHANGE, F.greatest("start_line", "end_line") + AFTER_CHANGE
    near = F.exists("changed", lambda x: x.between(low, high))
    joined = findings.join(c, keys, "left")
    return joined.withColumn("introduced", F.when(F.col("_known").isNull(), True).otherwise(F.coalesce(near, F.lit(False)))).drop("changed", "_known")


def with_registry(findings: DataFrame) -> DataFrame:
    """`findings` with detector, cwe, owasp and report level; the registry is eleven literals, not a join."""
    cwe, owasp = _map({t: c for t, c, _ in REGISTRY}), _map({t: o for t, _, o in REGISTRY})
    return findings.withColumns({"detector": detector_of(F.col("type")), "cwe": F.element_at(cwe, F.col("type")), "owasp": F.element_at(owasp, F.col("type")), "level": level_of(F.col("severity"))})


def report_form(findings: DataFrame) -> DataFrame:
    """The form that reports use: one line, no low severity."""
    return findings.withColumn("severity", F.when(F.col("severity") == "low", "medium").otherwise(F.col("severity"))).withColumnRenamed("message", "why").withColumnRenamed("start_line", "line")


def per_family(findings: DataFrame, by: list[str], kind: str = "detector") -> DataFrame:
    """Counts per family as one map per group; families are combined before the groups meet."""
    counts = findings.groupBy(*by, kind).agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("families"), F.sum("n").alias("total"))


def family_totals(runs: DataFrame, families: str = "findings_by_family") -> DataFrame:
    """family, findings over maps per run: positive totals, largest first, then by name."""
    rows = runs.select(F.explode(families).alias("family", "n"))
    return rows.groupBy("family").agg(F.sum("n").alias("findings")).where("findings > 0").orderBy(F.desc("findings"), "family")


def severity_breakdown(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")))


def workflow_status(classified: Column, fixes: Column, errors: Column) -> Column:
    return (
        F.when((classified == 0) & (errors == 0), "no_action")
        .when((classified > 0) & (fixes == 0), "failed")
        .when((fixes > 0) & (errors > 0), "partial_success")
        .when(fixes > 0, "success")
        .otherwise("failed")
    )


def automation_reason(status: Column, low_quality: Column, warnings: Column, calls_failed: Column, detectors_failed: Column) -> Column:
    """Why a scan's patches may or may not be applied unseen; degraded coverage comes before all else."""
    calls = F.when(calls_failed > 0, F.concat(calls_failed.cast("string"), F.lit(" LLM call(s) failed")))
    thrown = F.when(detectors_failed > 0, F.concat(detectors_failed.cast("string"), F.lit(" detector(s) threw")))
    degraded = F.concat(F.lit("Detection coverage degraded: "), F.concat_ws("; ", calls, thrown), F.lit(" — results are incomplete, do not treat as a clean scan"))
    return (
        F.when((calls_failed > 0) | (detectors_failed > 0), degraded)
        .when(status == "failed", "Workflow failed")
        .when(status == "partial_success", "Partial success: errors occurred during fix generation")
        .when(status == "no_action", "No classified vulnerabilities to automate")
        .when((status == "success") & (low_quality > 0), "Low-quality patches detected")
        .when((status == "success") & warnings, "Warnings present in patches")
        .when(status == "success", "All patches high/medium quality and no warnings")
        .otherwise("Automation not ready")
    )


def newest_per(rows: DataFrame, by: list[str], order: list, most: int, into: str = "rank") -> DataFrame:
    """The first `most` rows of each group, with their rank; limited before the shuffle."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(into) <= most)
