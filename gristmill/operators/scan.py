"""One scan, from files to findings: triggers and pairs of every detector, verdicts, gates, one list in registry order.

What a detector asks is a row of (path, family, pair_index); recorded verdicts are joined to it. The
literal tier needs no verdict: there the match is the finding. Findings of all detectors are united in
registry order, pass the tenant's settings, and the first of those with one path, line and type stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.functions.catalog import patterns
from gristmill.operators import findings, matching, pairing, review, verdicts


@dataclass(frozen=True)
class Detector:
    """family, the type of its findings, how it finds what to ask, and whether its matches need no verdict."""

    family: str
    type: str
    finds: str = "earliest"
    regex_only: bool = False


# The registry, in its order.
REGISTRY = (
    Detector("auth-bypass", "auth_bypass_risk", "preferred"),
    Detector("secrets-exposure", "secrets_exposure_risk", "unredacted", regex_only=True),
    Detector("webhook-unverified", "webhook_unverified_risk"),
    Detector("env-exposure", "env_exposure_risk"),
    Detector("admin-check", "admin_check_risk"),
    Detector("idor", "idor_risk", "pairs"),
)
SEVERITY = "critical"
# End of fixed values.

ASKED = ("path", "family", "pair_index", "line", "pattern_id", "rule_id", "tier", "route_trigger")


def _asked(rows: DataFrame, family: Column, rule: Column) -> DataFrame:
    route = F.col("pattern_id").endswith("_route_def") | F.col("pattern_id").endswith("_handler_def")
    return rows.select("path", family.alias("family"), F.col("pair_index").cast("int").alias("pair_index"), "line", "pattern_id", rule.alias("rule_id"), "tier", route.alias("route_trigger"))


def asked(files: DataFrame, registry: tuple = REGISTRY) -> DataFrame:
    """What the detectors of `registry` ask about `files` (path, content): `ASKED`, one row per trigger or pair.

    Detectors that take the earliest match share one pass over the contents.
    """
    one = lambda rows, family: _asked(rows.withColumns({"pair_index": F.lit(0), "family": F.lit(family)}), F.col("family"), verdicts.rule_id(F.col("family"), F.col("pattern_id")))
    out = []
    early = [d for d in registry if d.finds == "earliest"]
    if early:
        rows = reduce(lambda df, d: matching.earliest_hit(df, patterns(d.family), f"_{d.family}"), early, files)
        hits = F.filter(F.array(*(F.struct(F.lit(d.family).alias("family"), F.col(f"`_{d.family}`").alias("h")) for d in early)), lambda x: x["h"].isNotNull())
        found = rows.select("path", F.explode(hits).alias("x")).select("path", "x.family", "x.h.*", F.lit(0).alias("pair_index"))
        out.append(_asked(found, F.col("family"), verdicts.rule_id(F.col("family"), F.col("pattern_id"))))
    for d in registry:
        own = patterns(d.family)
        tiers = F.create_map(*(F.lit(x) for p in own for x in (p.id, p.tier)))
        tier = F.element_at(tiers, F.col("pattern_id"))
        if d.finds == "preferred":
            out.append(one(matching.preferred_trigger(matching.line_hits(files, own)).withColumn("tier", tier), d.family))
        elif d.finds == "unredacted":
            out.append(one(matching.unredacted_hit(files, own).withColumn("tier", tier), d.family))
        elif d.finds == "pairs":
            pairs = pairing.nearest_pairs(matching.all_hits(files, own)).withColumns({"line": F.col("sink_line"), "pattern_id": F.col("sink_id"), "tier": F.lit("judgment")})
            out.append(_asked(pairs, F.lit(d.family), verdicts.rule_id(F.lit(d.family), F.col("source_id"), F.col("sink_id"))))
    return reduce(DataFrame.unionByName, out)


def judged(rows: DataFrame, recorded: DataFrame, registry: tuple = REGISTRY, validate: bool = False, escalate: bool = False) -> DataFrame:
    """`rows` of `asked` with outcome and confidence under the `recorded` verdicts (path, family, pair_index, place, is_vulnerable, confidence, caller_auth, operation_class, second).

    Unless `validate`, matches of the literal tier of regex-only detectors and of admin checks are emitted
    without a verdict, with high confidence (`bypassed`). `second` counts only with `escalate`.
    """
    regex_only = [d.family for d in registry if d.regex_only]
    keyed = rows.withColumn("request_key", F.concat_ws("|", "family", "path"))
    given = recorded.withColumn("request_key", F.concat_ws("|", "family", "path")).drop("family", "path")
    gated = verdicts.gate(verdicts.attach(keyed, given), escalate)
    literal = (F.col("tier") == "literal") & F.col("family").isin(*regex_only, "admin-check") & F.lit(not validate)
    return gated.withColumns({"bypassed": literal, "outcome": F.when(literal, "emitted").otherwise(F.col("outcome")), "confidence": F.when(literal, "high").otherwise(F.col("confidence"))}).drop("request_key")


def emitted(rows: DataFrame, registry: tuple = REGISTRY) -> DataFrame:
    """The findings among `rows` of `judged`: place (of the detector in the registry), detector, type, path, start_line, end_line, rule_id, confidence, severity."""
    place = F.create_map(*(F.lit(x) for i, d in enumerate(registry) for x in (d.family, i)))
    kind = F.create_map(*(F.lit(x) for d in registry for x in (d.family, d.type)))
    hit = rows.where(F.col("outcome") == "emitted")
    return hit.select(F.element_at(place, F.col("family")).alias("place"), F.col("family").alias("detector"), F.element_at(kind, F.col("family")).alias("type"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "rule_id", "confidence", F.lit(SEVERITY).alias("severity"), "pair_index")


def united(found: DataFrame) -> DataFrame:
    """One finding for each path, line and type: the first in registry order, then by pair. Combined before the shuffle."""
    return findings.first_wins(found, ["path", "start_line", "type"], ["place", "pair_index", "rule_id"])


def with_scanner(scanned: DataFrame, in_diff: DataFrame, key: list[str]) -> DataFrame:
    """A scanner's findings and those of the diff as one list, the scanner's first; of equal `key` the first stays."""
    both = scanned.withColumn("_from", F.lit(0)).unionByName(in_diff.withColumn("_from", F.lit(1)))
    return findings.first_wins(both, key, ["_from"]).withColumn("origin", F.when(F.col("_from") == 0, "scanner").otherwise("diff")).drop("_from")


def routed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with the detector that handles their type, counts of those without one by type)."""
    known = found.withColumn("handler", findings.detector_of(F.col("type")))
    return known.where("handler IS NOT NULL"), known.where("handler IS NULL").groupBy("type").agg(F.count("*").alias("skipped"))


def coverage_gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of file results (calls_failed, aborted, detectors_failed): degradations, and files that can't be read as clean."""
    gap = (F.col("calls_failed") > 0) | F.col("aborted") | (F.col("detectors_failed") > 0)
    return rows.groupBy(*by).agg((F.sum("calls_failed") + F.count_if("aborted") + F.sum("detectors_failed")).alias("degradations"), F.count_if(gap).alias("files_with_gaps"), F.count("*").alias("files"))


def patch_counts(fixes: DataFrame, by: list[str]) -> DataFrame:
    """Per group of fix attempts (quality, error): fixes and how many of each quality; a failed attempt counts as an error."""
    ok = F.col("error").isNull()
    of = lambda q: F.count_if(ok & (F.col("quality") == q) if q != "low" else ok & ~F.coalesce(F.col("quality").isin("high", "medium"), F.lit(False)))
    return fixes.groupBy(*by).agg(F.count_if(ok).alias("fixes"), of("high").alias("high_quality"), of("medium").alias("medium_quality"), of("low").alias("low_quality"), F.count_if(~ok).alias("errors"))


def reported(found: DataFrame, files: DataFrame) -> DataFrame:
    """`found` (path, type, start_line, route) at the line that its verdict speaks of, with the code there.

    The route that a verdict names is looked up in the file (path, content); without one, or if no definition
    fits, the finding stays at its match. Files without findings are never cut into lines.
    """
    id_ = F.concat_ws("|", "path", "type", F.col("start_line").cast("string"))
    asked = found.join(files.select("path", "content"), "path").withColumns({"id": id_, "fallback": F.col("start_line")})
    at = review.route_anchor(asked)
    return at.select(*(c for c in found.columns if c != "start_line"), F.col("line").alias("start_line"), text.snippet(F.col("content"), F.col("line")).alias("code"))


def unpatched(found: DataFrame) -> DataFrame:
    """Fixes of findings (with code, explanation) that no patch can make: the code stays as it is, of low quality, with the reason. Patch counts read them like any other."""
    kept = {"fixed_code": F.col("code"), "quality": F.lit("low"), "warnings": F.array(F.lit("needs a person's choice; no automatic patch")), "error": F.lit(None).cast("string")}
    return found.withColumns(kept).withColumn("explanation", F.coalesce(F.nullif(F.trim("explanation"), F.lit("")), F.lit("Expose chosen values only, or guard the route.")))
