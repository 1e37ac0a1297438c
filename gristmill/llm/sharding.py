"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it level by level: of a node's children the
one with the smallest draw wins. A shard draws `-ln(u) / weight`, where u in (0, 1) is a hash of
(row key, shard); a rack or region draws the least of what its shards draw, which is distributed
exactly as one draw `-ln(u) / W` with the subtree's total weight W, so each child wins in
proportion to its weight. As no draw depends on another shard, a change of weights moves rows only
into or out of the shards whose weights change, whatever subtree they lie in. A tree of n shards is
one fixed tree (`grid`), and shard n always joins it as the same shard: the step from n to n + 1
takes rows only into the new shard (law `key`), for every n. Independent draws a level could not
hold that: a region that gains a shard would draw rows which its old shards then share.

Everything is built-in SQL functions: a hash per shard, then a least draw per level; no row is
shuffled to place it. Slots (gapless row numbers within a shard) need one shuffle of narrow
rows: (shard, bucket) groups are numbered apart and shifted by the counts of earlier buckets.

Edge cases: a null text has no bytes (size 1, CRC 0); a null doc_id is a key like any other;
repeated rows get the same shard and different slots; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.runtime import cut, fresh

#: Groups in which the rows of one shard are numbered apart.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A region, a rack or the root: its children."""

    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def grid(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Node:
    """The tree of `shards` equal shards, filled rack by rack and region by region."""
    leaves = [Shard(i) for i in range(shards)]
    racks = [Node(tuple(leaves[k : k + per_rack])) for k in range(0, shards, per_rack)]
    return Node(tuple(Node(tuple(racks[k : k + racks_per_region])) for k in range(0, len(racks), racks_per_region)))


def _draw(key: Column, shard: Shard) -> Column:
    # 52 bits of the hash, half a step off both ends: never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard{shard.number}")), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.struct((-F.log(u) / F.lit(float(shard.weight))).alias("draw"), F.lit(shard.number).alias("shard"))


def descend(key: Column, node: Node) -> Column:
    """(draw, shard): the least draw below `node` and where it leads; shards or subtrees of weight 0 get nothing."""
    below = [_draw(key, c) if isinstance(c, Shard) else descend(key, c) for c in node.children if c.weight > 0]
    return F.least(*below) if len(below) > 1 else below[0]


def place(docs: DataFrame, tree: Node, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """`docs` with the column `into`: the shard of each row."""
    return docs.withColumn(into, descend(F.coalesce(F.col(key).cast("string"), F.lit("\u0000null")), tree)["shard"].cast("int"))


def with_slots(placed: DataFrame, shard: str, order: list[str], into: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """`placed` with gapless row numbers from 0 within each shard, in the order of (bucket, `order`).

    No task holds a whole shard: buckets are hashes of the order columns, and the counts that
    shift them are shards x buckets rows, whatever the input. Rows equal in every column are
    interchangeable: those of one input partition are counted, numbered as one row and dealt their
    numbers afterwards, so that many such rows are at most one row a partition in any window. Rows
    equal in `order` only take their numbers in the order of their other columns.
    """
    names = placed.columns
    part, alike, bucket, start, last = (fresh(names, x) for x in ("part", "alike", "bucket", "start", "last"))
    groups = placed.withColumn(part, F.spark_partition_id()).groupBy(*names, part).agg(F.count("*").alias(alike))
    groups = groups.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = groups.groupBy(shard, bucket).agg(F.sum(alike).alias(alike))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum(alike).over(before), F.lit(0)).alias(start))
    rest = [c for c in names if c not in (shard, *order)]
    upto = F.sum(alike).over(Window.partitionBy(shard, bucket).orderBy(*order, *rest, part).rowsBetween(Window.unboundedPreceding, 0))
    ends = groups.withColumn(last, upto).join(F.broadcast(starts), [shard, bucket])  # at most shards x buckets rows
    first = F.col(start) + F.col(last) - F.col(alike)
    return ends.select(*names, F.explode(F.sequence(first, first + F.col(alike) - 1)).alias(into))


def shard_documents(docs: DataFrame, shards: int = 16, law: str = "key") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard of a tree of one more, for all rows.

    `docs` needs doc_id and text. The narrow rows are written once: the counts and the numbering
    both read them without the texts.
    """
    if law != "key":
        raise ValueError("the hash tree keeps the law `key`")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = place(place(narrow, grid(shards)), grid(shards + 1), into="grown_shard")
    numbered = with_slots(cut(narrow), "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")
