"""Mixing sources to target weights.

Tokens (words) are added up per source; targets share a budget by source weight with a cap of
`most` times the source's size; the repetition rate of a source is target / size. Each document
is taken floor(rate) times, plus once more if a uniform number hashed from its id, text and the
seed is below the fraction of the rate. The only shuffle is of one partial sum per source and
task; the documents stay where they are.

Edge cases: a null or empty text has no words; a null source is a source, last in order; sources
without words have target 0 and take nothing; repeated rows are taken alike (the draw depends
on doc_id and text only, so reruns agree); an empty table gives no rows; other columns, also
named like the results, are ignored or replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.runtime import cut, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20


def words_in(text) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id, text, seed: int = SEED):
    """A number in [0, 1) from MD5 of seed, id and text: the same in every run and engine."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Sources in code-point order, null last, weigh `weights` in turn. Targets are
    min(weight * level, most * source_size); the level is found on the sources sorted by
    most * size / weight: below the level a source is at its cap, above it has its weighted share.
    This is the fixed point of resharing the excess by weight. One row per source goes through
    these windows, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    budget = F.sum(F.col("source_size").cast("double")).over(everything) * F.lit(float(share))
    levels = capped.withColumn("level", (budget - before) / rest)
    first_free = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(F.col("weight") * first_free, F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def rates(narrow: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`narrow` (with source, size) plus source_size, target and rate."""
    per_source = cut(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    side = per_source.select(F.col("source").alias("_source"), "source_size", "target")
    joined = narrow.join(small_side(side, per_source.count()), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(rate, u):
    """floor(rate), plus one where the hashed uniform is below the fraction."""
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for all rows of `docs` (doc_id, text, source)."""
    narrow = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u")))
    n = copies(F.col("rate"), F.col("u"))
    return rates(narrow, weights, share, most).select("doc_id", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken"))


def repeat(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: `docs`, each row as often as it is taken, with its own columns.

    The rates come from a pass over (source, size); the texts are read once more, not shuffled.
    """
    narrow = docs.select("source", words_in(F.col("text")).alias("size"))
    per_source = cut(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    side = per_source.select(F.col("source").alias("_mix_source"), rate.alias("_mix_rate"))
    joined = docs.join(small_side(side, per_source.count()), docs["source"].eqNullSafe(F.col("_mix_source")), "left")
    n = copies(F.col("_mix_rate"), uniform(docs["doc_id"], docs["text"], seed))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).where(n > 0).select(*[docs[c] for c in docs.columns])
