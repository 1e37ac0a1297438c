"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent passes (left to right and right to left) of `HIDDEN` gated units read windows of
`WINDOW` bytes; their states at a position give language probabilities for that position, and a
document's probabilities are the mean over all its bytes. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled windows (`SAMPLE_DOCS` documents,
`PER_LANGUAGE` of one language, `EXCERPT` characters each, chosen by hash); its 60 kB of weights
go to the executors, which label every byte of every text, many windows at a time.

Never used as inputs: lang, source and doc_id of the document to predict. Documents whose
crc32(doc_id) mod 5 is 0 are held out of training.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is everything if
there is nothing to learn from; rows with a null doc_id are predicted, but not learned from;
texts of any length are read whole, window by window; repeated rows get the same answer; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.scan import slices
from gristmill.runtime import cut, ship, small_side

ship(__name__)
ship("gristmill.llm.scan")

HIDDEN = 8
WINDOW = 64
SAMPLE_DOCS, PER_LANGUAGE, EXCERPT = 4000, 500, 256
FOLDS, HELD_OUT = 5, 0
BATCH, STEPS, RATE, SEED = 256, 160, 0.03, 7
#: Windows that go through the network together.
LANES = 1024
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last one filled with zeros."""
    return np.frombuffer(data + b"\0" * (-len(data) % WINDOW), np.uint8).reshape(-1, WINDOW)


class Network:
    """Weights: per direction, inputs (byte -> gates), recurrent matrix, and the output layer.

    Gates are ordered update, reset, candidate. A sigmoid is computed as (1 + tanh(x / 2)) / 2.
    Arrays are laid out (direction, unit, lane), so that lanes are contiguous.
    """

    def __init__(self, languages: list[str], seed: int = SEED):
        r, h, k = np.random.default_rng(seed), HIDDEN, len(languages)
        self.languages = languages
        self.w = {
            "x": r.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
            "u": r.normal(0, 0.5 / h**0.5, (2, 3 * h, h)).astype(np.float32),
            "o": r.normal(0, 0.3, (2, k, h)).astype(np.float32),
            "b": np.zeros((k, 1), np.float32),
        }

    def states(self, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(step, direction, unit, lane); step t of direction 1 has read the window from its end."""
        x, u, h = self.w["x"], self.w["u"], HIDDEN
        n, steps = rows.shape
        table = np.ascontiguousarray(x.transpose(0, 2, 1))
        cols = np.ascontiguousarray(rows.T).astype(np.intp)
        out = np.empty((steps, 2, h, n), np.float32)
        state = np.zeros((2, h, n), np.float32)
        for t in range(steps):
            gates = np.stack([table[0].take(cols[t], axis=0).T, table[1].take(cols[steps - 1 - t], axis=0).T])
            rec = u @ state
            zr = gates[:, : 2 * h] + rec[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            cand = zr[:, h:] * rec[:, 2 * h :]
            cand += gates[:, 2 * h :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((state, zr, rec[:, 2 * h :], cand))
            state = state - cand
            state *= zr[:, :h]
            state += cand
            out[t] = state
        return out

    def positions(self, out: np.ndarray, t: int) -> np.ndarray:
        """(language, lane) probabilities at position t of the windows."""
        o = self.w["o"]
        logits = o[0] @ out[t, 0] + o[1] @ out[len(out) - 1 - t, 1] + self.w["b"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """(window, language) sums of the probabilities of all bytes other than zero."""
        total = np.zeros((len(rows), len(self.languages)))
        for at in range(0, len(rows), LANES):
            part = rows[at : at + LANES]
            out, real = self.states(part), (part != 0).T.astype(np.float32)
            sums = np.zeros((len(self.languages), len(part)), np.float32)
            for t in range(part.shape[1]):
                sums += self.positions(out, t) * real[t]
            total[at : at + LANES] = sums.T
        return total

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        x, u, o, h = self.w["x"], self.w["u"], self.w["o"], HIDDEN
        n, steps = rows.shape
        kept: list = []
        out = self.states(rows, kept)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        real = (rows != 0).T.astype(np.float32)
        count = max(real.sum(), 1)
        d_out, loss = np.zeros_like(out), 0.0
        for t in range(steps):
            p = self.positions(out, t)
            loss -= float((np.log(p[labels, np.arange(n)] + 1e-9) * real[t]).sum())
            p[labels, np.arange(n)] -= 1
            p *= real[t] / count
            g["b"][:, 0] += p.sum(axis=1)
            for d, s in ((0, t), (1, steps - 1 - t)):
                g["o"][d] += p @ out[s, d].T
                d_out[s, d] += o[d].T @ p
        carry = np.zeros_like(out[0])
        hot = np.zeros((2, 256, 3 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            before, zr, rec, cand = kept[t]
            z, r = zr[:, :h], zr[:, h:]
            carry += d_out[t]
            d_cand = carry * (1 - z) * (1 - cand * cand)
            d_zr = np.concatenate([carry * (before - cand), d_cand * rec], axis=1) * zr * (1 - zr)
            d_rec = np.concatenate([d_zr, d_cand * r], axis=1)
            d_in = np.concatenate([d_zr, d_cand], axis=1)
            g["u"] += d_rec @ before.transpose(0, 2, 1)
            for d, s in ((0, t), (1, steps - 1 - t)):
                np.add.at(hot[d], rows[:, s], d_in[d].T)
            carry = carry * z + u.transpose(0, 2, 1) @ d_rec
        g["x"] += hot.transpose(0, 2, 1)
        return loss / count, g


def train(examples: list[tuple[str, bytes]], seed: int = SEED, steps: int = STEPS) -> Network | None:
    """A network for the languages of `examples` (language, text); the same for the same examples."""
    languages = sorted({lang for lang, _ in examples})
    pools = [np.concatenate([windows(t) for lang, t in examples if lang == name and t] or [np.zeros((0, WINDOW), np.uint8)]) for name in languages]
    filled = [i for i, p in enumerate(pools) if len(p)]
    if not filled:
        return None
    net, r = Network(languages, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for step in range(1, steps + 1):
        labels = np.array(filled)[r.integers(0, len(filled), BATCH)]  # languages in equal shares
        rows = np.stack([pools[i][r.integers(0, len(pools[i]))] for i in labels])
        cut = np.where(r.random(BATCH) < 0.25, r.integers(4, WINDOW, BATCH), WINDOW)  # short texts, too
        rows = rows * (np.arange(WINDOW) < cut[:, None]).astype(np.uint8)
        _, g = net.gradients(rows, labels)
        norm = sum(float((x * x).sum()) for x in g.values()) ** 0.5
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in net.w.items():
            x = g[k] / max(1.0, norm)
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
            w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """The bounded training sample: excerpts of labelled documents outside the held-out fold, by hash.

    A threshold on the hash, set from the number of each language's ids that have a text (estimated
    within a few hundredths), lets about half as many again through as are taken, so what is ranked
    follows the sample and not the table; rows of one id count once.
    """
    chosen = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = cut(chosen.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")))
    share = F.least(F.lit(1.0), F.lit(1.5 * PER_LANGUAGE) / F.col("_n"))
    limits = counts.select("lang", F.when(share < 1, ((share - F.lit(0.5)) * F.lit(2.0**64)).cast("long")).otherwise(F.lit((1 << 63) - 1)).alias("_limit"))
    rows = chosen.select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h"))
    few = rows.join(small_side(limits, counts.count()), "lang").where(F.col("h") <= F.col("_limit"))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1) + 1
    parts = few.select("lang", "h", F.substring("text", start.cast("int"), F.lit(EXCERPT)).alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= PER_LANGUAGE)
    return [(x.lang, x.part.encode()) for x in ranked.orderBy("rank", "lang").limit(SAMPLE_DOCS).collect()]


def predict(net: Network | None, texts: list) -> list[tuple[str, float]]:
    """(language, score) of whole texts; None and texts without a letter are unknown."""
    datas = [t.encode("utf-8", "surrogatepass").replace(b"\0", b" ") if net and t and any(map(str.isalpha, t)) else b"" for t in texts]
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    at = 0
    while at < len(datas):  # a few megabytes of windows at a time
        end, size = at, 0
        while end < len(datas) and (end == at or size < 1 << 22):
            size += len(datas[end])
            end += 1
        rows = [windows(d) for d in datas[at:end]]
        sums = net.pooled(np.concatenate(rows)) if size else None
        first = 0
        for i, r in zip(range(at, end), rows):
            if len(r):
                p = sums[first : first + len(r)].sum(axis=0)
                best = int(p.argmax())
                out[i] = (net.languages[best], float(min(1.0, p[best] / p.sum())))
            first += len(r)
        at = end
    return out


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `docs` (doc_id, text)."""

    def run(batches):
        for batch in slices(batches):
            got = predict(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Trains on `docs` (doc_id, text, lang) and predicts all its rows."""
    return identify(docs, train(sample(docs)))


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with a score of at least `least`."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            got = predict(net, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
