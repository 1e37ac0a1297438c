"""Proximity pairing of sources and sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
NEAR_LINES = 200
MOST_PAIRS = 12
# End of fixed values.

#: Lines of a file that are searched together, in multiples of the reach.
STRIP = 50
#: Lines at most that a task sorts on average, where the hits are counted.
LINES = 500_000


def _within(line: Column, found: Column, near: int) -> Column:
    """(distance, ord, pos, pattern_id, line) of a source, or null beyond the reach."""
    gap = F.abs(line - found["line"])
    return F.when(gap <= near, F.struct(gap.alias("distance"), found["ord"].alias("ord"), found["pos"].alias("pos"), found["pattern_id"].alias("pattern_id"), found["line"].alias("line")))


def nearest_pairs(hits: DataFrame, near: int = NEAR_LINES, most: int = MOST_PAIRS, counted: int | None = None) -> DataFrame:
    """From hits (path, role, pattern_id, ord, pos, line): per sink line its nearest source.

    The first sink of a line in (ord, pos) stands for it; the nearest source wins, ties by
    (ord, pos); pairs are numbered by sink line, the first `most` kept, `truncated` counts the rest.
    Hits are first reduced to one row a line. A sink's nearest source is the last one above it or the
    first one below it, so two running values over the lines find it, without a join. Files are cut
    into strips of `STRIP` times the reach, and sources near an edge count in both strips: no window
    holds more than a strip, however long a file is. With the hits' `counted` number, strips are dealt into
    as many tasks as it asks for; adaptive execution would pack them by their compressed bytes.
    """
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("ord", "pos", "pattern_id", "line"))).alias(role)
    lines = hits.groupBy("path", "line").agg(first("source"), first("sink"))
    size = near * STRIP
    strip, inside = F.floor(F.col("line") / size), F.pmod("line", F.lit(size))
    edge = F.col("source").isNotNull()
    copies = F.array_compact(F.array(strip, F.when(edge & (inside < near), strip - 1), F.when(edge & (inside >= size - near), strip + 1)))
    dealt = lines.withColumn("_own", strip).withColumn("_strip", F.explode(copies))
    if counted is not None:
        parts = max(hits.sparkSession.sparkContext.defaultParallelism, math.ceil(counted / LINES))
        dealt = dealt.repartition(parts, "path", "_strip")
    order = Window.partitionBy("path", "_strip")
    before = F.last("source", ignorenulls=True).over(order.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("source", ignorenulls=True).over(order.orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0))
    seen = dealt.withColumn("_before", before).withColumn("_after", after).where("sink IS NOT NULL AND _strip = _own")
    nearest = F.array_min(F.array_compact(F.array(_within(F.col("line"), F.col("_before"), near), _within(F.col("line"), F.col("_after"), near))))
    found = seen.select("path", F.col("line").alias("sink_line"), "sink", nearest.alias("s")).where("s IS NOT NULL")
    of_path = Window.partitionBy("path")
    ranked = found.withColumns({"pair_index": F.row_number().over(of_path.orderBy("sink_line")) - 1, "n": F.count("*").over(of_path)}).where(F.col("pair_index") < most)
    return ranked.select(
        "path", "pair_index", F.col("s.pattern_id").alias("source_id"), F.col("s.line").alias("source_line"), F.col("sink.pattern_id").alias("sink_id"), "sink_line", F.col("s.distance").alias("distance"), F.greatest(F.col("n") - most, F.lit(0)).alias("truncated")
    )
