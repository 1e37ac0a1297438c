"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as an array of part boundaries beside an array of ranks, one for each pair of
adjacent parts. The smallest rank is found by scanning the array, its boundary is deleted and
the ranks on either side are looked up again, until no pair has a rank. Scanning beats a queue
while words are short; words beyond `SHORT` parts keep their candidate pairs in a heap instead,
with the same result in n log n steps.

The vocabulary file (tokenizer JSON) is read by the driver and broadcast, about 2 MB: lower-case
word-level BPE with word ends, white space dropped, no decoder. Decoding joins tokens by blanks.

Edge cases: a null text counts as empty (no tokens); texts and words of any length are encoded
whole; added tokens' strings in a text become their ids, as the tokenizers library does; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gristmill.llm.scan import slices
from gristmill.runtime import ship

ship(__name__)
ship("gristmill.llm.scan")

#: Parts up to which the array is scanned.
SHORT = 128
#: Words kept encoded by a Python worker, the bytes that these and their ids may take, and the longest one kept; pieces get a third of both. At a limit either starts afresh.
CACHE, CACHE_BYTES, KEPT_LENGTH = 600_000, 120_000_000, 1_000
#: Bytes of a dictionary's entry, with its free places.
ENTRY = 50
#: The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
# Where Python's and regex's character tables are older or newer than the tokenizers library's.
#: Upper-case letters that Python does not know yet: first, last, and the first one's lower case (others follow).
LATER_CASE = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Letters and numbers of regex's tables that the library takes for neither: first, last.
NO_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# End of fixed values.
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Kept(dict):
    """Ids (bytes) of words or pieces; what isn't kept comes from `miss`."""

    def __init__(self, miss):
        super().__init__()
        self.miss = miss

    def __missing__(self, key: str) -> bytes:
        return self.miss(key)


class WordBpe:
    """Encoder and decoder for one tokenizer JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.token = np.array([token.get(i) for i in range(max(token) + 1)], object)
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        odd = "".join(f"{chr(a)}-{chr(b)}" for a, b in NO_LETTERS)
        rule = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", f"[[^{WHITE}\\p{{L}}\\p{{N}}][{odd}]]").replace(r"[\p{L}]", f"[\\p{{L}}--[{odd}]]").replace(r"|[\p{N}]|", f"|[\\p{{N}}--[{odd}]]|")
        self.pieces = regex.compile(rule, regex.V1)
        self.odd_case = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in LATER_CASE) + "]")
        self.later = {a + i: low + i for a, b, low in LATER_CASE for i in range(b - a + 1)}
        self.white = regex.compile(f"[{WHITE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known, self.known_pieces = Kept(self.word), Kept(self.piece)
        self.held = [0, 0]

    def parts(self, piece: str) -> list[str]:
        """Tokens of one piece of a text, before ids."""
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.end
        return self.scan(symbols) if len(symbols) <= SHORT else self.queue(symbols)

    def scan(self, symbols: list[str]) -> list[str]:
        """Merges by boundaries: part i lies between `at[i]` and `at[i + 1]`, and `adjacent[i]` ranks it with the next one."""
        rank, none, text = self.ranks.get, len(self.ranks), "".join(symbols)
        at = [0, *accumulate(map(len, symbols))]
        adjacent = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while adjacent and (least := min(adjacent)) < none:
            i = adjacent.index(least)
            del at[i + 1], adjacent[i]
            merged = text[at[i] : at[i + 1]]
            if i < len(adjacent):
                adjacent[i] = rank((merged, text[at[i + 1] : at[i + 2]]), none)
            if i:
                adjacent[i - 1] = rank((text[at[i - 1] : at[i]], merged), none)
        return [text[a:b] for a, b in zip(at, at[1:])]

    def queue(self, symbols: list[str]) -> list[str]:
        """The same merges for a long word: pairs wait in a heap by (rank, place); stale ones are skipped."""
        ranks, n = self.ranks, len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if symbols[i] else n
            if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [s for s in symbols if s]

    def keep(self, place: int, cache: Kept, key: str, ids: bytes) -> bytes:
        """Puts a word (place 0) or a piece (1) into its cache, which starts afresh when it would outgrow its limits."""
        if len(key) <= KEPT_LENGTH:
            size = ENTRY + sys.getsizeof(key) + sys.getsizeof(ids)
            if self.held[place] + size > CACHE_BYTES // (1, 3)[place] or len(cache) >= max(CACHE // (1, 3)[place], 1):
                cache.clear()
                self.held[place] = 0
            cache[key] = ids
            self.held[place] += size
        return ids

    def piece(self, piece: str) -> bytes:
        ids = [self.vocab[t] for t in self.parts(piece)]
        return self.keep(1, self.known_pieces, piece, struct.pack(f"<{len(ids)}I", *ids))

    def word(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a string without white space. A word of one piece shares its key and ids with this."""
        pieces = self.pieces.findall(word)
        ids = self.known_pieces[word] if pieces == [word] else b"".join(map(self.known_pieces.__getitem__, pieces))
        return self.keep(0, self.known, word, ids)

    def words(self, text: str) -> list[str]:
        """The normal form of a text, cut at white space."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter for itself: no final sigma
        if not text.isascii() and self.odd_case.search(text):
            text = text.translate(self.later)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for str.split(), but not white space
            return [w for w in self.white.split(text) if w]
        return text.split()

    def encode_bytes(self, text: str) -> tuple[bytes, str, int]:
        """(ids as little-endian 32-bit bytes, decoded text, number of ids) of a whole text."""
        out, known = [], self.known.__getitem__
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append(struct.pack("<I", self.added[part]))
            else:
                out += map(known, self.words(part))
        data = b"".join(out)
        ids = np.frombuffer(data, "<u4")
        return data, self.decode(ids), len(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return " ".join(self.token[np.asarray(ids, np.intp)].tolist())


def _run(docs: DataFrame, path: str, row, schema: str) -> DataFrame:
    """Maps (doc_id, text) rows through an encoder; `row` makes the columns after doc_id."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"source": f.read()})
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        here = shared.value  # one object per Python worker: the encoder and its words serve its later tasks, too
        bpe = here["bpe"] = here.get("bpe") or WordBpe(here["source"])
        for batch in slices(batches):
            rows = [(i, *row(bpe, text or "")) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digests(bpe: WordBpe, text: str) -> tuple:
    ids, decoded, n = bpe.encode_bytes(text)
    return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, for every whole text."""
    return _run(docs, path, _digests, SCHEMA)


def _full(bpe: WordBpe, text: str) -> tuple:
    ids, decoded, n = bpe.encode_bytes(text)
    return n, np.frombuffer(ids, "<u4").astype(np.int32), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the ids themselves and the digests of ids and decoded text."""
    return _run(docs, path, _full, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
