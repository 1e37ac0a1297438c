"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import cut, packed


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of every row for each of the named pairs of columns; the rows are made once, where they lie."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) plus m: the smallest of u and its neighbours. Minima are combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest one."""
    both = _each(edges, ("u", "v"), ("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these. Edges go from larger to smaller."""
    return _each(_with_least(edges), ("v", "m"), ("u", "m")).where("u <> v")


def _state(edges: DataFrame) -> tuple:
    edges = edges.coalesce(edges.sparkSession.sparkContext.defaultParallelism)
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (u, v, comparable and not null): root is the smallest node reachable.

    Each step is group-minimum plus equi-join; a node with very many links is combined before the
    shuffle and its join partition is split by adaptive execution. Rounds grow with the logarithm
    of the longest path; only a count and a checksum reach the driver. Each half of a round is
    written to the checkpoint folder, and takes as many tasks as the counted links ask for. An empty table gives no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        half = packed(cut(_large_star(packed(now, state[0]))), state[0])  # a row for each link; the small star reads it twice
        now = cut(_small_star(half).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    now = packed(now, state[0])
    return _each(now, ("u", "v"), ("v", "v")).distinct().toDF("node", "root")
