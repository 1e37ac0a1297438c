"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

Patterns find e-mail addresses, IP numbers, payment cards (Luhn) and phone numbers in every whole
text. The field labels the tokens around digits, @ and +: each token has shape features, neighbours
share a chain potential, and successive occurrences of the same token (or the same digits) in a
document share a skip potential, however far apart; links go from one occurrence to the next, so
they grow with the tokens. Loopy message passing on log messages gives each token's marginals,
for many documents at once. Weights are fitted on the driver by gradient steps on the same message
passing, from a bounded sample of documents (`SAMPLE_DOCS` of at most `SAMPLE_CHARS` characters)
whose tokens the patterns label. Tokens that reach `SURE` and lie outside all pattern spans become
further spans of their kind.

Edge cases: a null text counts as empty; offsets are code points; texts of any length are read
whole, in linear time; repeated rows give repeated results; if no sampled text holds a candidate
nothing is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.scan import joined, sha256, slices
from gristmill.runtime import hashed_sample, ship

ship(__name__)
ship("gristmill.llm.scan")

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
K = len(LABELS)
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behind only keeps long digit runs from being tried at every digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[^ \t-\r]+")

SAMPLE_DOCS, SAMPLE_CHARS = 1500, 10_000
STEPS, RATE, PENALTY = 60, 0.3, 1e-3
ROUNDS = 12
SURE = 0.95
#: Candidate tokens of a batch of documents that pass messages together.
NODES = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """(start, end) of e-mail addresses: from each @ to both sides, as a leftmost search finds them."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = AFTER_AT.match(text, at) if start < at else None
        at = at + 1
        if m:
            yield start, m.end()
            free = at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns find."""
    if not CANDIDATE.search(text):
        return []
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    # compared as digit strings: a part may be longer than int() allows
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return out


FEATURES = ["bias", "at", "at_dot", "dots3", "plus", "letters", "hex", "paren", "hyphen", "prev_plus", "prev_number", "next_number", "prev_paren", "none", *(f"digits{i}" for i in range(9)), *(f"prev_digits{i}" for i in range(9))]
PLACE = {f: i for i, f in enumerate(FEATURES)}
BUCKETS = (0, 3, 6, 9, 12, 13, 16, 19)


def bucket(n: int) -> int:
    return sum(n > b for b in BUCKETS)


def shape(token: str, before: str, after: str) -> list[int]:
    """Features of a token and its neighbours, not knowing the patterns."""
    digits, prev = len(only_digits(token)), len(only_digits(before))
    core = token.strip(".,;:!?\"'#*$%&()")
    got = ["bias", f"digits{bucket(digits)}", f"prev_digits{bucket(prev)}"]
    got += [name for name, on in (
        ("at", "@" in token), ("at_dot", "." in token.partition("@")[2]), ("dots3", core.count(".") == 3 and digits > 3), ("plus", token.startswith("+")),
        ("letters", any(map(str.isalpha, core))), ("hex", digits > 8 and any(c in "abcdef" for c in core)), ("paren", "(" in token), ("hyphen", "-" in core),
        ("prev_plus", before.startswith("+")), ("prev_paren", "(" in before), ("prev_number", prev > 0), ("next_number", any("0" <= c <= "9" for c in after)), ("none", not core),
    ) if on]
    return [PLACE[g] for g in got]


def same_key(token: str) -> str | None:
    """What repeated or similar tokens have in common: their digits if these are many, else the bare word of an address."""
    digits, core = only_digits(token), token.strip(".,;:!?\"'#*$%&()").casefold()
    return digits if len(digits) >= 6 else core if "@" in token or (core.count(".") == 3 and digits) else None


@dataclass
class Graph:
    """Tokens of many documents, their features, and chain and skip links."""

    spans: list = field(default_factory=list)  # (document, start, end)
    features: list = field(default_factory=list)
    chain: list = field(default_factory=list)
    skip: list = field(default_factory=list)

    def add(self, doc: int, text: str) -> None:
        """Adds the candidate tokens of a text and their direct neighbours."""
        tokens = list(TOKEN.finditer(text))
        words = [t[0] for t in tokens]
        hits = [i for i, w in enumerate(words) if CANDIDATE.search(w)]
        last: dict[str, int] = {}
        previous = -2
        for i in sorted({j for h in hits for j in (h - 1, h, h + 1) if 0 <= j < len(words)}):
            node = len(self.spans)
            self.spans.append((doc, tokens[i].start(), tokens[i].end()))
            self.features.append(shape(words[i], words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
            if previous == i - 1:
                self.chain.append((node - 1, node))
            if (key := same_key(words[i])) is not None:
                if key in last and last[key] != node - 1:
                    self.skip.append((last[key], node))
                last[key] = node
            previous = i


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights: features -> labels, and the potentials of chain and skip links."""

    def __init__(self):
        self.w = {"f": np.zeros((len(FEATURES) + 1, K)), "chain": np.zeros((K, K)), "skip": np.zeros((K, K))}

    @staticmethod
    def arrays(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers (padded by one without weight), link ends, and which links skip."""
        index = np.full((len(g.features), max(map(len, g.features))), len(FEATURES))
        for i, f in enumerate(g.features):
            index[i, : len(f)] = f
        return index, np.array(g.chain + g.skip, np.int64).reshape(-1, 2), np.arange(len(g.chain) + len(g.skip)) >= len(g.chain)

    def marginals(self, index: np.ndarray, links: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of tokens and of linked pairs, by loopy message passing."""
        own = self.w["f"][index].sum(axis=1)
        pair = np.where(skips[:, None, None], self.w["skip"], self.w["chain"])
        a, b = links[:, 0], links[:, 1]
        to_b, to_a = np.zeros((len(links), K)), np.zeros((len(links), K))
        for _ in range(ROUNDS if len(links) else 0):
            belief = self._gather(own, a, b, to_a, to_b)
            new_b = _log_sum((belief[a] - to_a)[:, :, None] + pair, 1)
            new_a = _log_sum((belief[b] - to_b)[:, None, :] + pair, 2)
            to_b = 0.5 * to_b + 0.5 * (new_b - _log_sum(new_b, 1)[:, None])
            to_a = 0.5 * to_a + 0.5 * (new_a - _log_sum(new_a, 1)[:, None])
        belief = self._gather(own, a, b, to_a, to_b)
        node = np.exp(belief - _log_sum(belief, 1)[:, None])
        both = (belief[a] - to_a)[:, :, None] + pair + (belief[b] - to_b)[:, None, :]
        flat = both.reshape(len(links), K * K)
        return node, np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(-1, K, K) if len(links) else both

    @staticmethod
    def _gather(own, a, b, to_a, to_b):
        out = own.copy()
        for k in range(K):  # sums of incoming messages
            out[:, k] += np.bincount(a, to_a[:, k], len(own)) + np.bincount(b, to_b[:, k], len(own))
        return out

    def fit(self, g: Graph, labels: np.ndarray) -> None:
        """Gradient steps on the likelihood of `labels`, with expectations from message passing."""
        index, links, skips = self.arrays(g)
        v = {k: np.full_like(w, 1e-6) for k, w in self.w.items()}
        true_nodes = np.eye(K)[labels]
        true_pairs = true_nodes[links[:, 0]][:, :, None] * true_nodes[links[:, 1]][:, None, :]
        for step in range(STEPS):
            nodes, pairs = self.marginals(index, links, skips)
            grad = {k: -PENALTY * w for k, w in self.w.items()}
            gap = (true_nodes - nodes) / len(nodes)
            np.add.at(grad["f"], index.ravel(), np.repeat(gap, index.shape[1], axis=0))
            rest = (true_pairs - pairs) / len(nodes)
            grad["chain"] = grad["chain"] + rest[~skips].sum(axis=0)
            grad["skip"] = grad["skip"] + rest[skips].sum(axis=0)
            grad["skip"] = (grad["skip"] + grad["skip"].T) / 2
            for k, w in self.w.items():
                v[k] = 0.9 * v[k] + 0.1 * grad[k] ** 2
                w += RATE * (1 - step / STEPS) * grad[k] / (np.sqrt(v[k]) + 1e-3)
            self.w["f"][-1] = 0


def labels_of(g: Graph, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """The label of each token: the kind of a pattern span that it overlaps."""
    out = np.zeros(len(g.spans), np.int64)
    for i, (doc, s, e) in enumerate(g.spans):
        for kind, a, b in spans[doc]:
            if a < e and s < b:
                out[i] = LABELS.index(kind)
                break
    return out


def train(texts: list[str]) -> Field | None:
    g, spans = Graph(), [base_spans(t) for t in texts]
    for i, t in enumerate(texts):
        g.add(i, t)
    if not g.spans:
        return None
    f = Field()
    f.fit(g, labels_of(g, spans))
    return f


def sample(docs: DataFrame) -> list[str]:
    """The bounded training sample, by hash; texts that hold a candidate."""
    rows = docs.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@+]")).select("doc_id", "text")
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).first()["n"]  # repeated rows count once
    return [x.text for x in hashed_sample(rows, distinct, SAMPLE_DOCS).collect()]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation around it."""
    while start < end and not (text[start].isalnum() or text[start] == "+"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def added_spans(field_: Field | None, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Per text the spans that the field adds: sure tokens outside all pattern spans, neighbours of one kind joined."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at = 0
    while field_ is not None and at < len(texts):
        g = Graph()
        while at < len(texts) and len(g.spans) < NODES:
            if CANDIDATE.search(texts[at]):
                g.add(at, texts[at])
            at += 1
        if not g.spans:
            continue
        p = field_.marginals(*field_.arrays(g))[0]
        best, top = p.argmax(axis=1), p.max(axis=1)
        sure = top >= SURE
        for a, b in [*g.chain, *reversed(g.chain)]:  # the rest of an entity whose part is sure
            if best[a] == best[b] and (sure[a] or sure[b]):
                sure[a], sure[b] = top[a] >= 0.5, top[b] >= 0.5
        for i in np.flatnonzero((best > 0) & sure):
            doc, s, e = g.spans[i]
            text, kind = texts[doc], LABELS[best[i]]
            if not CANDIDATE.search(text, s, e) or any(a < e and s < b for _, a, b in base[doc]):
                continue
            s, e = trimmed(text, s, e)
            last = out[doc][-1] if out[doc] else None
            if last and last[0] == kind and kind in ("card", "phone") and not text[last[2] : s].strip(" ()-"):
                out[doc][-1] = (kind, last[1], e)
            elif s < e:
                out[doc].append((kind, s, e))
    return out


def find(field_: Field | None, texts: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(field_, texts, base)))


def find_personal_data(docs: DataFrame, field_: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of the pattern spans, and all spans, of every whole text."""
    field_ = field_ or train(sample(docs))

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for doc_id, (base, more) in zip(batch.column(0).to_pylist(), find(field_, texts)):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, *counts, sha256(joined(base, KINDS)), joined(base + more, KINDS)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span replaced by the name of its kind; overlapping spans by the first one's."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field_: Field | None = None) -> DataFrame:
    """`docs`, all columns, with personal data in text replaced; n_chars, if there, follows the text."""
    field_, names, schema = field_ or train(sample(docs)), docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = find(field_, [t or "" for t in texts])
            new = [t if not (base or more) else redacted(t, base + more) for t, (base, more) in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                chars = [n if a is b else len(b) for n, a, b in zip(columns[i].to_pylist(), texts, new)]
                columns[i] = pa.array(chars, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
