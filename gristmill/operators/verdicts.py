"""Recorded verdicts: validation, joining to what was asked, and the gates after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CONFIDENCE = ("high", "medium", "low")
CALLER = ("authenticated", "unauthenticated", "unclear")
OPERATION = ("administrative", "ordinary", "unclear")
# End of fixed values.


def valid(verdicts: DataFrame) -> DataFrame:
    """Verdicts with a boolean outcome and a confidence of the enumeration (case folded); lane facts default to unclear."""
    lane = lambda c, ok: F.when(F.lower(c).isin(*ok), F.lower(c)).otherwise("unclear").alias(c)
    keep = verdicts.where(F.col("is_vulnerable").isNotNull() & F.lower("confidence").isin(*CONFIDENCE))
    rest = [c for c in verdicts.columns if c not in ("confidence", "caller_auth", "operation_class")]
    return keep.select(*rest, F.lower("confidence").alias("confidence"), lane("caller_auth", CALLER), lane("operation_class", OPERATION))


def attach(asked: DataFrame, verdicts: DataFrame, key: str = "request_key", index: str = "pair_index", order: str = "place") -> DataFrame:
    """`asked` left-joined to the first valid verdict of each (key, index); `judged` tells whether there is one.

    Verdicts for indexes that were not asked fall away with the join; unjudged rows stay visible.
    """
    rest = [c for c in verdicts.columns if c not in (key, index)]
    first = valid(verdicts).groupBy(key, index).agg(F.min_by(F.struct(*rest), order).alias("v"))
    joined = asked.join(first, [key, index], "left")
    return joined.select(*asked.columns, *[F.col(f"v.`{c}`").alias(c) for c in rest if c != order], F.col("v").isNotNull().alias("judged"))


def lane(family: Column, caller: Column, operation: Column, route_trigger: Column) -> Column:
    """The sibling family that a finding is left to, or null."""
    idor = F.when(caller == "unauthenticated", "auth-bypass").when(operation == "administrative", "admin-check")
    auth = F.when(route_trigger & (caller == "authenticated") & (operation == "administrative"), "admin-check")
    return F.when(family == "idor", idor).when(family == "auth-bypass", auth)


def gate(judged: DataFrame, escalate: bool = False) -> DataFrame:
    """`judged` with `outcome`: unjudged, safe, low, deferred, review-queue or emitted.

    Medium confidence waits in the review queue unless escalation is on; then `second` (promote,
    drop or null) decides: promoted to high, dropped, or kept as it is when the second look failed.
    """
    medium = F.when(F.col("second") == "promote", "emitted").when(F.col("second") == "drop", "safe").otherwise("review-queue") if escalate else F.lit("review-queue")
    outcome = (
        F.when(~F.col("judged"), "unjudged")
        .when(~F.col("is_vulnerable"), "safe")
        .when(F.col("confidence") == "low", "low")
        .when(lane(F.col("family"), F.col("caller_auth"), F.col("operation_class"), F.col("route_trigger")).isNotNull(), "deferred")
        .when(F.col("confidence") == "medium", medium)
        .otherwise("emitted")
    )
    return judged.withColumn("outcome", outcome)


def rule_id(family: Column, *parts: Column) -> Column:
    return F.concat_ws("-", family, *parts)


def coverage(calls: DataFrame) -> DataFrame:
    """One row: attempted, failed, and failures by reason and by caller, of calls (ok, reason, caller, auxiliary)."""
    own = calls.where("NOT auxiliary")
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("key")), F.struct(F.lit("caller").alias("kind"), F.col("caller").alias("key")))
    counts = own.select("ok", F.explode(kinds).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("bad") > 0) & F.col("key").isNotNull(), F.struct("key", F.col("bad").alias("n"))))))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "all", F.col(c))), F.lit(0)).alias({"n": "attempted", "bad": "failed"}[c])
    return counts.agg(total("n"), total("bad"), of("reason").alias("by_reason"), of("caller").alias("by_caller"))
