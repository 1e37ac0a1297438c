import random
import re
from collections import Counter

import numpy as np

from gristmill.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reference(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def test_statistics_equal_brute_force():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", "é", " ", "  ", "\n", "\t", "\x1c", "\xa0", "#", "|", "ab "]) for _ in range(r.randint(0, 80)))
        assert Q.statistics(text) == reference(text), text
    long = " ".join(f"w{r.randint(0, 9000)}" for _ in range(20_000)) + " x y z u v" * 2
    assert Q.statistics(long) == reference(long)


def prose(r, n):
    return ". ".join(" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(12)) for _ in range(n))


def test_outliers_go_and_clean_texts_stay(make):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(2, 60)), "en", "a") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(r, 8).split()), "en", "a") for i in range(20)]
    got = {x.doc_id: x for x in Q.judge(make(rows)).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(20))


def test_steps_find_the_majority(spark):
    r = np.random.default_rng(0)
    good, bad = r.normal([1.6, 0, 0, 0], 0.2, (400, 4)), r.normal([3.0, 2, 2, 2], 0.05, (120, 4))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([good, bad])], "g string, x0 double, x1 double, x2 double, x3 double")
    est = Q.robust_estimates(rows).first()
    assert np.allclose(est["mean"], good.mean(axis=0), atol=0.08)


def test_small_groups_borrow_from_wider_ones():
    """One document says little, a thousand say almost all; in between the estimate moves without a jump."""
    usual, own = np.array([m for m, _ in Q.USUAL]), np.array([2.0, 0.3, 0.3, 0.3])
    at = [Q.drawn([(own, np.full(10, 0.01) * np.array([i == j for i, j in Q.MOMENTS]), float(n))])[0] for n in (1, 10, 29, 30, 31, 1000)]
    share = [float(((m - usual) / (own - usual)).mean()) for m in at]
    assert share == sorted(share) and share[0] < 0.04 and share[-1] > 0.96 and max(share[3] - share[2], share[4] - share[3]) < 0.01


def quartile(values, share):
    return sorted(values)[max(1, int(np.ceil(share * len(values)))) - 1]


def brute_kept(rows):
    """Verdicts of (statistics, lang, source), by plain loops over each group's documents."""
    x, judged = [], []
    for (n, chars, *rest), lang, source in rows:
        words = n + 50.0
        x.append([np.log((chars + 250.0) / words), *(np.log1p(v / words) for v in rest)])
        judged.append(not (n < 10 or 100 * rest[2] > 20 * n))
    x = np.array(x)
    floor = np.square([0.05, 0.04, 0.04, 0.04])

    def estimate(own):
        factor, results = Q.consistency(0.75), []
        spread = np.array([((quartile(c, 0.75) - quartile(c, 0.25)) / 1.349) ** 2 for c in own.T]) + floor
        starts = [(np.array([quartile(c, 0.5) for c in own.T]), np.diag(spread)), (own.mean(axis=0), np.cov(own.T, bias=True).reshape(4, 4) + np.diag(floor))]
        for mean, cov in starts:
            for _ in range(4):
                d = np.einsum("ni,ij,nj->n", own - mean, np.linalg.inv(cov), own - mean)
                bins = np.clip(np.floor(np.log(d + 1e-4) * 12), -240, 240)
                near = np.zeros(len(own), bool)
                for b in np.unique(bins):
                    if (bins < b).sum() < np.ceil(len(own) * 0.75):
                        near |= bins == b
                part = own[near]
                mean, cov = part.mean(axis=0), np.cov(part.T, bias=True).reshape(4, 4) * factor + np.diag(floor)
            results.append((np.linalg.det(cov), mean, cov))
        return min(results, key=lambda r: r[0])[1:]

    out = []
    group = {}
    for i, (_, lang, source) in enumerate(rows):
        if judged[i]:
            for key in ((), (lang,), (lang, source)):
                group.setdefault(key, []).append(i)
    made = {key: (*estimate(x[ids]), len(ids)) for key, ids in group.items()}
    for i, (_, lang, source) in enumerate(rows):
        if not judged[i]:
            out.append(False)
            continue
        mean, cov = np.array([np.log(5.0), 0.02, 0.02, 0.02]), np.diag(np.square([0.3, 0.15, 0.15, 0.15]))
        for key in ((), (lang,), (lang, source)):
            m, c, n = made[key]
            w = n / (n + 30.0)
            mean, cov = w * m + (1 - w) * mean, w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
        d = x[i] - mean
        out.append(not (d @ np.linalg.inv(cov) @ d > 33.4 and (abs(d[0]) > 0 or (d[1:] > 0).any())))
    return out


def test_verdicts_equal_brute_force(spark):
    from gristmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], brute_kept([(reference(r.text or ""), r.lang, r.source) for r in docs])))
    got = {r.doc_id: r.kept for r in QUERIES["op5_robust_outliers"](spark, sf).collect()}
    assert got == want and not all(got.values())


def test_edges(make, awkward, empty, clashing):
    got = {r.doc_id: r for r in Q.judge(awkward).collect()}
    assert Q.judge(awkward).count() == 10 and got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].base_failed and got[4].n_repeat_words == got[4].n_words
    assert Q.judge(empty).count() == 0 and Q.judge(clashing).count() == 3


def test_query_base_columns(spark, sf):
    from gristmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_robust_outliers"](spark, sf).collect():
        n, chars, symbols, lines, repeats = reference(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)


def test_consistency_factor():
    assert abs(Q.consistency(0.75) - 1.486) < 0.01
