"""Near copies by the similarity of shingle sets: SimHash links and MinHash bands find candidates, exact counts decide.

Two texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or
more. Texts with equal sets collapse first. Sets whose SimHash fingerprints are linked (`simhash`, at
most 3 bits) are candidates. A pair at 0.8 differs in about 10 bits, so bands find what lies beyond
those: each distinct set is keyed by `BANDS` bands of `ROWS`
minima: a pair at 0.8 shares a band with a probability of 1 - (1 - 0.8^4)^20 = 0.99997, a closer
one with more. Sets that share a band are held against each other by bitmaps of their shingles: a
bit that only one of them has is a shingle that the other lacks, so the bits bound what they can
share from above. The join emits the pairs whose bound reaches 0.8; these are verified by counting
the shingles they share. Nothing is lost, as the bound holds for every pair.

In a band bucket of up to `HOT` sets all pairs are held so. In a larger one each set meets `CELLS`
pivots first; then the sets outside the bucket's largest component meet all of the bucket's sets in
other components. Pairs left out lie within one component, so components are those of all pairs. A
large bucket emits links, not pairs; it compares bitmaps as often as its size times the number of
sets that its largest component does not hold.

Edge cases: null and empty texts have an empty set and are copies of each other; a text of fewer
than five words is one shingle; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.components import components
from gristmill.llm.scan import slices
from gristmill.runtime import counted, cut, packed, ship

ship(__name__)

SHINGLE = 5
SEED = 42
BANDS, ROWS = 20, 4
#: The least similarity is 4 / 5. Different sets of fewer than 4 shingles are always below it.
SHARED, OF = 4, 5
#: Sets up to which all pairs of a bucket are compared, and pivots of a larger one.
HOT = 16
CELLS = 16
#: Longs of a bitmap: 1,024 bits, sparse up to some 500 shingles; fuller ones bound less, and more pairs are counted.
WORDS = 16
#: Shingles in all up to which the sets are broadcast to the pairs.
SMALL = 2_000_000
#: Shingles mixed at a time.
CHUNK = 1 << 12
#: Odd multipliers: one for each minimum of a sketch, one for each place of a shingle.
_R = np.random.default_rng(SEED)
MIXERS = _R.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _R.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a UTF-8 text; of the whole text if it is shorter.

    Each word is hashed once; the hashes of a shingle's words are folded together, place by place.
    """
    words = text.lower().split()  # A-Z only, as in simhash
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(PLACES):
        out = (out ^ out >> np.uint64(29) ^ hashed[k : k + n]) * m
    return np.unique(out ^ out >> np.uint64(32))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of the minima of a set; none of a set too small to have near copies."""
    if len(found) < SHARED:
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[at : at + CHUNK] * MIXERS).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def bitmap(found: np.ndarray) -> np.ndarray:
    """`WORDS` longs with the bit of each shingle set."""
    bits = np.zeros(WORDS * 64, np.uint8)
    bits[(found % np.uint64(WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def simhash(found: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).astype(np.int64)


def _mapped(docs: DataFrame, names: list[str], of, schema: str) -> DataFrame:
    """The columns `names` of `docs` and what `of` (text -> values) makes of its text, as `schema`."""

    def run(batches):
        for batch in slices(batches):
            made = list(zip(*(of(t or b"") for t in batch.column("_text").to_pylist())))
            types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
            kinds = [part.split()[1] for part in schema.split(", ")]
            columns = [batch.column(c) for c in names] + [pa.array(v, types[k]) for v, k in zip(made, kinds)]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(part.split()[0] for part in schema.split(", "))])

    rows = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"]
    return rows.mapInArrow(run, ", ".join([*kept, schema]))


def sketches(docs: DataFrame, names: list[str]) -> DataFrame:
    """`names`, and set (hash of the shingle set), n (its size), fp (its SimHash), bands (their keys) and bits (the bitmap) of each text."""

    def of(text):
        found = shingles(text)
        key, fp = _signed([xxhash.xxh64_intdigest(found.tobytes(), SEED), simhash(found)]).tolist()
        return key, len(found), fp, _signed(bands(found)), bitmap(found)

    return _mapped(docs, names, of, "set long, n int, fp long, bands array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, names: list[str]) -> DataFrame:
    """`names` and shingles, the distinct shingle hashes of each text."""
    return _mapped(docs, names, lambda text: (_signed(shingles(text)),), "shingles array<long>")


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets, looked up in `sets` (set, shingles), are similar enough."""
    small = (sets.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0) <= SMALL
    side = F.broadcast if small else lambda rows: rows
    left = side(sets.select(F.col("set").alias("u"), F.col("shingles").alias("a")))
    right = side(sets.select(F.col("set").alias("v"), F.col("shingles").alias("b")))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(OF * both >= SHARED * (F.size("a") + F.size("b") - both)).select("u", "v")


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("key", F.col("set").alias(name), *(F.col(c).alias(f"_{c}_{name}") for c in ("n", "bits", *more)))


def _reach() -> Column:
    """Whether the bitmaps of u and v leave room for the least similarity: shared / (n + n - shared) at the most they can share."""
    lacking = lambda a, b: sum((F.bit_count(F.col(f"_bits_{a}")[i].bitwiseAND(F.bitwise_not(F.col(f"_bits_{b}")[i]))) for i in range(WORDS)), F.lit(0))
    most = F.least(F.col("_n_u") - lacking("u", "v"), F.col("_n_v") - lacking("v", "u"))
    return (OF + SHARED) * most >= SHARED * (F.col("_n_u") + F.col("_n_v"))


def _pairs(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """The (u, v) of one bucket whose bitmaps leave room for the least similarity, once for each bucket that they share."""
    met = left.join(right, (left["key"] == right["key"]) & where & _reach())
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def candidates(members: DataFrame, hot: int) -> DataFrame:
    """(u, v) to verify among `members` (key, set, n, bits, members): from all pairs of a small bucket, from pivots of a larger one."""
    few, many = members.where(F.col("members") <= hot), members.where(F.col("members") > hot)
    pairs = _pairs(_side(few, "u"), _side(few, "v"), F.col("u") > F.col("v"))
    pivot = many.groupBy("key", F.pmod(F.xxhash64("set"), F.lit(CELLS)).alias("cell")).agg(F.min(F.struct("set", "n", "bits")).alias("p")).select("key", "p.*")
    stars = _pairs(_side(many, "u"), _side(pivot, "v"), F.col("u") != F.col("v"))
    return pairs.unionByName(stars)


def apart(many: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v) still to verify in the large buckets `many`: sets outside a bucket's main component, with all in other components, given `roots` (set, root)."""
    placed = cut(many.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    rest = placed.join(main, "key").where("root <> main")
    return _pairs(_side(rest, "u", "root"), _side(placed, "v", "root"), F.col("_root_u") != F.col("_root_v")).distinct()


def linked_pairs(linked: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (u, v) of `linked` whose bitmaps, in `distinct` (set, n, bits), leave room for the least similarity, the larger set first."""
    ends = [distinct.select(F.col("set").alias(c), F.col("n").alias(f"_n_{c}"), F.col("bits").alias(f"_bits_{c}")) for c in ("u", "v")]
    met = linked.join(ends[0], "u").join(ends[1], "v").where(_reach())
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def groups(distinct: DataFrame, texts, hot: int = HOT, linked: DataFrame | None = None) -> DataFrame:
    """(set, root) of the sets of `distinct` (set, n, bands, bits) that are near another one: equal roots for one group.

    `texts` gives (set, shingles) for rows of sets. The pairs (u, v) of `linked` are verified with what bands
    find, in one pass. What the large buckets add is joined between the components found before, so that
    these are not computed again.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = packed(pairs, counted(pairs)).select(F.explode(F.array("u", "v")).alias("set")).distinct()
        return cut(near(pairs, cut(texts(wanted))))

    def rooted(edges: DataFrame) -> DataFrame:
        return cut(components(edges).select(F.col("node").alias("set"), "root"))

    keyed = distinct.select("set", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = cut(keyed.join(shared, "key").join(distinct.select("set", "n", "bits"), "set"))  # bitmaps join what shares a band only
    met = candidates(members, hot)
    first = cut((met if linked is None else met.unionByName(linked_pairs(linked, distinct))).distinct())
    roots = rooted(verified(first))
    many = members.where(F.col("members") > hot)
    more = first.limit(0) if many.isEmpty() else cut(apart(many, roots).join(first, ["u", "v"], "left_anti"))
    if more.isEmpty():
        return roots
    found = verified(more)
    alone = found.select(F.explode(F.array("u", "v")).alias("set")).distinct().join(roots, "set", "left_anti").withColumn("root", F.col("set"))
    all_roots = cut(roots.unionByName(alone))
    ends = [all_roots.select(F.col("set").alias(c), F.col("root").alias(f"r{c}")) for c in ("u", "v")]
    upper = rooted(found.join(ends[0], "u").join(ends[1], "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    return all_roots.join(upper.select(F.col("set").alias("root"), F.col("root").alias("top")), "root", "left").select("set", F.coalesce("top", "root").alias("root"))
