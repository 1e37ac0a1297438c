"""Helpers every operator shares: lineage cuts, checked broadcasts, table reads and code shipping."""

from __future__ import annotations

import math
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with a known row count may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a few numbers that one task takes on average, where they are counted.
NARROW_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only where none is set and all tasks run in this process (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gristmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder: later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of few numbers a row in as many tasks as its counted `rows` ask for; never in more than it has.

    Each task of a shuffle writes files of its own, so that a few rows in many tasks cost disk and time by the number of tasks.
    """
    return df.coalesce(max(1, math.ceil(rows / NARROW_ROWS)))


def counted(df: DataFrame) -> int:
    """The rows of a stored table, counted in as many tasks as there are cores."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()


def spread(df: DataFrame) -> DataFrame:
    """A scanned table, dealt to all cores if its files give fewer tasks than there are; a larger one is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` as a broadcast side if its counted `rows` are within `limit`; else left to the planner."""
    return F.broadcast(df) if rows <= limit else df


def fresh(names: list[str], stem: str) -> str:
    """A column name that none of `names` equals, whatever their case."""
    taken = {n.lower() for n in names}
    return next(n for n in (f"_{stem}{i or ''}" for i in range(len(names) + 1)) if n not in taken)


def hashed_sample(rows: DataFrame, total: int, n: int) -> DataFrame:
    """About the `n` distinct rows of `rows` (`total` in all) with the smallest hashes: the same for the same rows.

    A threshold on the hash, set from `total`, lets half as many again through, so what is sorted and
    sent on follows n and not the number of tasks; rows that repeat are combined before the shuffle.
    """
    share = min(1.0, 1.5 * n / max(total, 1))
    limit = (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * (1 << 64))
    names = rows.columns
    few = rows.withColumn("_h", F.xxhash64(*names)).where(F.col("_h") <= limit).dropDuplicates(["_h"])
    return few.orderBy("_h").limit(n).select(*names)


def ship(module: str) -> None:
    """Send the functions of `module` to executors by value, so that these need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
