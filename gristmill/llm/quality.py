"""Quality rules: fixed rules first, then robust multivariate outliers.

Five statistics of each whole text give a four-part vector on log scales (mean word length,
symbols, duplicate lines and repeated words, each shrunk for short texts). Per language and
source, the minimum covariance determinant is sought by concentration steps over all documents:
distances under the current estimate, then mean and covariance of the nearest three quarters.
A step is one aggregation of (group, start, distance bin) into counts and moments, so no group is
ever gathered: a hot group is a few hundred partial sums per task. Two starts run side by side
(quartiles; all rows) and the smaller determinant wins. Documents beyond `CUTOFF` squared
Mahalanobis distance are rejected, only on the bad side of the centre.

Estimates are made alike at three levels: language and source, language, and all documents. Each
level's estimate is drawn towards the next wider one's with the weight of `PRIOR_DOCS` documents, and
that of all documents towards a fixed broad one (`USUAL`). So a large group speaks for itself, a
small one borrows from its language, and nothing changes abruptly at any size.

The statistics of repeated words and duplicate lines can hardly reject on their own: what the base
rule leaves of the first lies within four floors of nothing, and the second needs a duplicate line
every four words. They count beside the others.

Edge cases: a null or empty text has no words and fails the base rule; null languages and
sources are groups like any other; repeated rows count as often as they occur; texts of any
length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.scan import slices
from gristmill.runtime import cut, ship, small_side

ship(__name__)
ship("gristmill.llm.scan")

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_SHARE = 20
#: Weight, in words, of the usual text that short texts are shrunk towards, and its letters a word.
PRIOR_WORDS, PRIOR_LETTERS = 50.0, 5.0
#: Least standard deviation of each part: what differs by less is never odd.
FLOOR = (0.05, 0.04, 0.04, 0.04)
#: Share of a group that a concentration step keeps, and number of steps.
NEAREST, STEPS = 0.75, 4
#: Documents that the next wider level's estimate counts for.
PRIOR_DOCS = 30.0
#: Mean and standard deviation of each part where nothing is known: words of five letters, little of the rest.
USUAL = ((math.log(5.0), 0.3), (0.02, 0.15), (0.02, 0.15), (0.02, 0.15))
#: Squared distance (chi-square of 4 degrees: one in a million or so) beyond which a text is rejected.
CUTOFF = 33.4
#: Distance bins: this many per unit of the logarithm, up to the outermost.
BINS, LAST_BIN = 12, 240
PARTS = ("x0", "x1", "x2", "x3")
MOMENTS = [(i, j) for i in range(4) for j in range(i, 4)]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of `WINDOW` words that occur at least twice, first occurrences included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    code, k = ids, len(numbers)
    for _ in range(WINDOW - 1):  # exact codes of ever longer windows, renumbered before they overflow
        if k * len(numbers) >= 1 << 62:
            code, k = np.unique(code, return_inverse=True)[1], len(code)
        code, k = code[:-1] * len(numbers) + ids[len(ids) - len(code) + 1 :], k * len(numbers)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    ends = np.zeros(n + 1, np.int64)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + WINDOW, -1)
    return int((np.cumsum(ends) > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """The statistics of a whole text, in the order of STATS."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every text."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches):
        for batch in slices(batches):
            rows = [statistics(t or "") for t in batch.column(3).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "lang", "source", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select("doc_id", "lang", "source").schema.fields)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, f"{kinds}, {STATS}")


def vector() -> list[Column]:
    """The transformed statistics."""
    words = F.col("n_words") + F.lit(PRIOR_WORDS)
    letters = (F.col("word_chars") + F.lit(PRIOR_WORDS * PRIOR_LETTERS)) / words
    rates = [F.log1p(F.col(c) / words) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return [x.alias(n) for x, n in zip([F.log(letters), *rates], PARTS)]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)


def grouped(stats: DataFrame) -> DataFrame:
    """`stats` with `levels`: the names of its groups, from language and source over language to all."""
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return stats.withColumn("levels", F.array(name("lang", "source"), name("lang"), F.lit("{}")))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0..x3 from `mean` under the inverse covariance `inv`."""
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(PARTS)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(MOMENTS):
        out = out + F.lit(1.0 if i == j else 2.0) * d[i] * d[j] * F.col("inv")[k]
    return out


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(PARTS)), *(F.sum(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"q{i}{j}") for i, j in MOMENTS)]


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest `share` right for normal data of 4 parts."""
    low, high = 0.0, 100.0
    for _ in range(80):  # the chi-square quantile, by halving
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


PARAMS = "g string, start int, mean array<double>, inv array<double>, cov array<double>, det double"
PACKED = tuple(zip(*MOMENTS))


def estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Means and inverse covariances from one row of moments per group and start."""

    def run(frames):
        for p in frames:
            if len(p):
                n = p["n"].to_numpy(float)
                mean = np.stack([p[f"s{i}"].to_numpy(float) for i in range(4)], 1) / n[:, None]
                cov = np.zeros((len(p), 4, 4))
                for i, j in MOMENTS:
                    cov[:, i, j] = cov[:, j, i] = p[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
                cov = cov * factor + np.diag(np.square(FLOOR))
                inv = np.linalg.inv(cov)
                yield pd.DataFrame({"g": p["g"], "start": p["start"], "mean": list(mean), "inv": [m[PACKED] for m in inv], "cov": [m[PACKED] for m in cov], "det": np.linalg.det(cov)})

    return sums.select("g", "start", *[c for c in sums.columns if c not in ("g", "start")]).mapInPandas(run, PARAMS)


def first_estimates(rows: DataFrame) -> DataFrame:
    """Start 0: medians, and variances from the quartiles; start 1: mean and covariance of all rows."""
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 2_000).alias(x) for x in PARTS]
    robust = rows.groupBy("g").agg(*quartiles)
    mean = F.array(*(F.col(x)[1] for x in PARTS))
    spread = [F.pow((F.col(x)[2] - F.col(x)[0]) / F.lit(1.349), 2) + F.lit(f * f) for x, f in zip(PARTS, FLOOR)]
    inv = F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i, j in MOMENTS))
    cov = F.array(*(spread[i] if i == j else F.lit(0.0) for i, j in MOMENTS))
    det = spread[0] * spread[1] * spread[2] * spread[3]
    robust = robust.select("g", F.lit(0).alias("start"), mean.alias("mean"), inv.alias("inv"), cov.alias("cov"), det.alias("det"))
    return robust.unionByName(estimates(rows.groupBy("g").agg(*_moments()).withColumn("start", F.lit(1)), 1.0))


def concentrate(rows: DataFrame, params: DataFrame, n_params: int) -> DataFrame:
    """One step: moments of the nearest rows of each group and start, whole distance bins at a time."""
    bins = F.least(F.greatest(F.floor(F.log(_distance() + F.lit(1e-4)) * BINS), F.lit(-LAST_BIN)), F.lit(LAST_BIN))
    binned = rows.join(small_side(params, n_params), "g").withColumn("bin", bins).groupBy("g", "start", "bin").agg(*_moments())
    own = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = binned.withColumn("before", before).withColumn("all", F.sum("n").over(own)).where(F.col("before") < F.ceil(F.col("all") * F.lit(NEAREST)))
    sums = [F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(4)), *(f"q{i}{j}" for i, j in MOMENTS)]]
    return estimates(near.groupBy("g", "start").agg(*sums), consistency(NEAREST))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """g, mean, cov for each group of `rows` (g, x0..x3): the smaller determinant of both starts."""
    params = cut(first_estimates(rows))
    n = params.count()
    for _ in range(STEPS):
        params = cut(concentrate(rows, params, n))
    best = params.groupBy("g").agg(F.min_by(F.struct("mean", "cov"), F.struct("det", "start")).alias("best"))
    return best.select("g", F.col("best.mean").alias("mean"), F.col("best.cov").alias("cov"))


def drawn(levels: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance from (mean, packed covariance, documents) of the levels, the widest first.

    A blend's covariance holds what its two means differ by.
    """
    mean = np.array([m for m, _ in USUAL])
    cov = np.diag(np.square([d for _, d in USUAL]))
    for own, packed, n in levels:
        c = np.zeros((4, 4))
        c[PACKED] = packed
        c = c + np.triu(c, 1).T
        w, d = n / (n + PRIOR_DOCS), own - mean
        mean, cov = w * own + (1 - w) * mean, w * c + (1 - w) * cov + w * (1 - w) * np.outer(d, d)
    return mean, np.linalg.inv(cov)[PACKED]


def blended(rows: DataFrame, found: DataFrame) -> DataFrame:
    """g (language and source), mean, inv: each group's estimate drawn towards its wider ones, of `rows` (levels) and `found` (g, mean, cov)."""
    sizes = rows.groupBy("levels").agg(F.count("*").alias("n"))  # a row a group: few
    every = sizes.select("n", F.posexplode("levels").alias("level", "g"))
    counted = every.groupBy("level", "g").agg(F.sum("n").alias("n")).join(found, "g").select("g", F.struct("level", "mean", "cov", "n").alias("e"))
    parts = sizes.select(F.col("levels")[0].alias("own"), F.explode("levels").alias("g")).join(counted, "g")
    gathered = parts.groupBy("own").agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))

    def run(frames):
        for p in frames:
            if len(p):
                made = [drawn([(np.array(e["mean"]), np.array(e["cov"]), float(e["n"])) for e in es]) for es in p["es"]]
                yield pd.DataFrame({"g": p["own"], "mean": [m for m, _ in made], "inv": [i for _, i in made]})

    return gathered.mapInPandas(run, "g string, mean array<double>, inv array<double>")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, distance and kept for all rows of `docs` (doc_id, text, lang, source)."""
    stats = cut(measure(docs))
    known = cut(grouped(stats).select("*", base_failed().alias("base_failed"), *vector()))
    judged = known.where(~F.col("base_failed"))
    params = cut(blended(judged, robust_estimates(judged.select(F.explode("levels").alias("g"), *PARTS))))
    scored = known.withColumn("g", F.col("levels")[0]).join(small_side(params, params.count()), "g", "left").withColumn("distance", _distance())
    worse = F.greatest(*(F.abs(F.col("x0") - F.col("mean")[0]) if i == 0 else F.col(x) - F.col("mean")[i] for i, x in enumerate(PARTS))) > 0
    odd = F.coalesce(worse & (F.col("distance") > CUTOFF), F.lit(False))
    return scored.select("doc_id", *[x.split()[0] for x in STATS.split(", ")], "base_failed", "distance", (~F.col("base_failed") & ~odd).alias("kept"))
