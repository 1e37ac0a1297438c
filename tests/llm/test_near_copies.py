import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import near_copies as N
from gristmill.llm import simhash as S


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))}


def close(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def near_texts(r, families, copies):
    """Texts of random words with some words replaced, at similarities around 0.8."""
    out = []
    for _ in range(families):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 300))]
        out.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for at in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 40))):
                words[at] = f"x{r.randrange(10**6)}"
            out.append(" ".join(words))
    return out


def groups(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if close(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_keep_one_equals_all_pairs(spark, make):
    texts = near_texts(random.Random(5), 25, 5)
    kept = {r.doc_id for r in S.keep_one(make(list(enumerate(texts)))).collect()}
    assert kept == groups(texts) and len(kept) < len(texts) / 2


@pytest.mark.parametrize("hot", [256, 3])
def test_links_of_small_and_large_buckets(spark, make, hot):
    base = near_texts(random.Random(6), 4, 30)
    docs = make(list(enumerate(base)))
    known = N.sketches(docs, ["doc_id"]).cache()
    distinct = known.groupBy("set").agg(*(F.first(c).alias(c) for c in ("n", "bands", "bits")))
    sets = known.select("set", "doc_id").join(N.shingle_sets(docs, ["doc_id"]), "doc_id").dropDuplicates(["set"]).select("set", "shingles")
    root = {r.set: r.root for r in N.groups(distinct, lambda wanted: sets.join(wanted, "set", "left_semi"), hot).collect()}
    of = {r.doc_id: r.set for r in known.collect()}
    got = {}
    for i in range(len(base)):
        got.setdefault(root.get(of[i], of[i]), []).append(i)
    assert {min(g) for g in got.values()} == groups(base) and len(got) < len(base)


def test_bitmaps_bound_what_sets_share():
    r = random.Random(7)
    for _ in range(300):
        size, common = r.randint(1, 900), r.random()
        a = np.array([r.getrandbits(64) for _ in range(size)], np.uint64)
        b = np.concatenate([a[: int(common * size)], np.array([r.getrandbits(64) for _ in range(r.randint(0, size))], np.uint64)])
        lacking = lambda x, y: sum(int(v).bit_count() for v in (N.bitmap(x).view(np.uint64) & ~N.bitmap(y).view(np.uint64)))
        shared = len(set(a.tolist()) & set(b.tolist()))
        assert shared <= min(len(a) - lacking(a, b), len(b) - lacking(b, a))


def test_keep_one_keeps_every_column(spark):
    """Helper names are no reason to change or lose a column; repeated rows and null ids count once."""
    rows = [(1, "a b c d e f g h", 7, "x", 3), (2, "a b c d e f g h", 8, "y", 4), (2, "a b c d e f g h", 8, "y", 4), (3, None, 9, "z", 5), (None, "", 1, "w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _Doc string, row int")
    got = S.keep_one(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[3]]


def test_short_texts_have_no_bands():
    assert N.bands(N.shingles(b"a b c")) == [] and len(N.shingles(b"")) == 0 and len(N.shingles(b"One two")) == 1
    assert len(N.bands(np.arange(5, dtype=np.uint64))) == N.BANDS


def test_simhash_links_join_near_copies_without_bands(spark, make, monkeypatch):
    """The blocks of op2's method find what lies within 3 bits, and only what shares its shingles is joined."""
    monkeypatch.setattr(N, "bands", lambda found: [])
    r, texts = random.Random(8), []
    for _ in range(8):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(["first", *words])]
    fps = [N.simhash(N.shingles(t.encode())) for t in texts]
    near = [i for i in range(len(texts)) if not any(close(shingle_set(texts[i]), shingle_set(texts[j])) and (fps[i] ^ fps[j]).bit_count() <= 3 for j in range(i))]
    kept = {row.doc_id for row in S.keep_one(make(list(enumerate(texts)))).collect()}
    assert kept == set(near) and len(kept) < len(texts) / 2


def test_simhash_of_a_set():
    r = random.Random(9)
    found = np.array([r.getrandbits(64) for _ in range(77)], np.uint64)
    assert N.simhash(found) == sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in found) > 77) and N.simhash(found[:0]) == 0


def test_links_and_bands_are_verified_in_one_pass(spark, make, monkeypatch):
    """Links and bands were verified one after the other, each with its own components: too much disk on many partitions."""
    r, passes, near = random.Random(9), [], N.near
    texts = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    texts = [" ".join([*words, *more]) for words in texts for more in ([], ["more"], ["and", "more"])]
    monkeypatch.setattr(N, "near", lambda pairs, sets: passes.append(1) or near(pairs, sets))
    kept = S.keep_one(make(list(enumerate(texts))))
    assert [x.doc_id for x in kept.select("doc_id").orderBy("doc_id").collect()] == [0, 3, 6, 9] and len(passes) == 1
