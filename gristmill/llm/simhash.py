"""SimHash near-duplicates by pigeonhole blocks.

Texts become 64-bit fingerprints of their word shingles. Fingerprints at most 3 bits apart agree
in at least 3 of 6 blocks, so each distinct fingerprint is keyed by every choice of 3 blocks
(20 keys of 32 bits or so), joined on equal keys and verified by Hamming distance. Exact copies
collapse before that: only distinct fingerprints are keyed.

A bucket of more than `HOT` fingerprints emits no pairs. Its members are linked through points of
the Hamming space instead: if x and y are at most 3 bits apart, a point lies within 1 bit of x and
2 bits of y. Every point within 1 bit of some member has a centre, the smallest such member, and
every member within 2 bits of the point is at most 3 bits from the centre; links to centres join
exactly what links between members join, with at most 2,081 rows per member whatever the bucket.

Components come from star contraction on the links; all documents of a fingerprint share its
component.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other; a
null doc_id takes part, but never names a component unless nothing else does (then null);
repeated rows share everything; texts of any length are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import near_copies
from gristmill.llm.components import components
from gristmill.llm.scan import slices
from gristmill.runtime import cut, fresh, ship, small_side

ship(__name__)
ship("gristmill.llm.scan")

BITS = 64
NEAR = 3
BLOCKS = 6
SHINGLE = 3
SEED = 42
#: Distinct fingerprints up to which a bucket's pairs are compared directly.
HOT = 256
#: Shingles hashed at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()  # A-Z only; blanks are 0x20 and 0x09-0x0D
    n = max(len(words) - width + 1, 1 if words else 0)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = [words[at + k : at + k + min(CHUNK, n - at) if len(words) >= width else None] for k in range(width)]
        shingles = map(b" ".join, zip(*part)) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: list) -> DataFrame:
    """`keys` (columns of `docs`) and fp, the fingerprint of text as a signed long."""

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t or b"") for t in batch.column("_text").to_pylist()], np.uint64).astype(np.int64)
            columns = [batch.column(c) for c in batch.schema.names if c != "_text"] + [pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in batch.schema.names if c != "_text"), "fp"])

    rows = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(run, f"{schema}, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int = BLOCKS, near: int = NEAR) -> list[int]:
    """Masks of every choice of blocks - near blocks: fingerprints `near` bits apart agree under one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - near)]


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= NEAR


def _ball(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*(F.lit(signed(m)) for m in masks)), lambda m: fp.bitwiseXOR(m)))


def hot_links(hot: DataFrame) -> DataFrame:
    """(u, v) links that join the fingerprints `fp` of `hot` at most 3 bits apart, through centres of points."""
    one = [0, *(1 << i for i in range(BITS))]
    two = one + [1 << i | 1 << j for i, j in combinations(range(BITS), 2)]
    centres = hot.select("fp", _ball(F.col("fp"), one).alias("point")).groupBy("point").agg(F.min("fp").alias("centre"))
    reach = hot.select("fp", _ball(F.col("fp"), two).alias("point"))
    return reach.join(centres, "point").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) links between the distinct fingerprints `fp`: all close pairs of small buckets, stars in hot ones."""
    masks = [signed(m) for m in block_masks()]
    keyed = distinct.select("fp", F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "key"))
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("members")).where("members > 1")
    members = cut(keyed.join(shared, ["choice", "key"]))
    few = members.where(F.col("members") <= hot)
    pairs = few.select("choice", "key", F.col("fp").alias("u")).join(few.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"])
    close = pairs.where((F.col("u") > F.col("v")) & _close(F.col("u"), F.col("v"))).select("u", "v")
    return close.unionByName(hot_links(members.where(F.col("members") > hot).select("fp").distinct())).distinct()


def fingerprint_components(known: DataFrame, name, hot: int = HOT) -> DataFrame:
    """fp and component for each distinct fp of `known`: the smallest value of `name` (a column; nulls ignored) reachable."""
    least = cut(known.groupBy("fp").agg(F.min(name).alias("least")))
    roots = components(links(least.select("fp"), hot)).select(F.col("node").alias("fp"), "root")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = joined.groupBy("root").agg(F.min("least").alias("component"))
    return joined.select("fp", "root").join(grouped, "root").select("fp", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of `docs` (doc_id, text)."""
    known = cut(fingerprints(docs, ["doc_id"]))
    groups = fingerprint_components(known, F.col("doc_id"))
    return known.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def linked_sets(sets: DataFrame) -> DataFrame:
    """(u, v) links between the sets of `sets` (set, fp) by op2's blocks: each set with the smallest of its fingerprint, these with each other at most 3 bits apart."""
    centres = cut(sets.groupBy("fp").agg(F.min("set").alias("centre")))
    same = sets.join(centres, "fp").where("set <> centre").select(F.col("set").alias("u"), F.col("centre").alias("v"))
    ends = [centres.select(F.col("fp").alias(f), F.col("centre").alias(c)) for f, c in (("u", "a"), ("v", "b"))]
    apart = links(centres.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return same.unionByName(apart)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near copies: the one with the smallest doc_id (null last), then row hash.

    Near copies share 0.8 or more of their 5-word shingles. Their SimHash fingerprints are linked as op2's
    are; links count if the shingles are shared, and what differs in more bits is found as `near_copies` says. Rows equal in every column are combined before the shuffle and count as one, so that many
    such rows don't meet in one task. Columns of any name keep their values: the helper's names are
    chosen apart from them. Null and empty texts are copies of each other; an empty table gives no rows.
    """
    names = docs.columns
    row, doc = fresh(names, "row"), fresh(names, "doc")
    rowed = docs.withColumns({row: F.xxhash64(*names), doc: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    keyed = rowed.dropDuplicates([doc, row])  # dealt once by what the last join needs
    narrow = rowed.select("doc_id", F.col(doc).alias("_doc"), F.col(row).alias("_row"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_doc", "_row")
    known = cut(near_copies.sketches(narrow, ["doc_id", "_doc", "_row"]))
    least = cut(known.groupBy("set").agg(F.min(order).alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "bits"))))

    def texts(wanted: DataFrame) -> DataFrame:
        one = cut(least.join(wanted, "set").select("set", "least._doc", "least._row"))
        found = narrow.drop("doc_id").join(small_side(one, one.count()), ["_doc", "_row"]).dropDuplicates(["set"])
        return near_copies.shingle_sets(found, ["set"])

    joined = least.select("set", "least").join(near_copies.groups(least, texts, linked=linked_sets(least.select("set", "fp"))), "set", "left").withColumn("root", F.coalesce("root", "set"))
    kept = joined.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first._doc").alias(doc), F.col("first._row").alias(row))
    return keyed.join(kept, [doc, row], "left_semi").select(*names)
