import hashlib
import random
import struct
import tracemalloc

import pytest
from tokenizers import Tokenizer

from gristmill.llm import bpe as B
from gristmill.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def ours():
    with open(TOKENIZER, encoding="utf-8") as f:
        return B.WordBpe(f.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(TOKENIZER)


def same(ours, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    got, decoded, n = ours.encode_bytes(text)
    assert ours.encode(text) == ids and n == len(ids) and got == struct.pack(f"<{n}I", *ids) and decoded == theirs.decode(ids, skip_special_tokens=False) == ours.decode(ids), text


def test_equals_the_library(ours, theirs):
    r = random.Random(5)
    letters = [chr(c) for c in [*range(0x250), 0x3A3, 0x3C3, 0x130, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x301, 0x327, 0x1C5, 0xBD, 0x2167, 0x660, 0xE0100, 0x10FFFF, 0xFDFA, 0x85]]
    for text in ["", "  ", "<|endoftext|>abc <|startoftext|> <|endoftext|", "it's we'll I'M they'VE", "ΑΣ ΟΔΟΣ Σ", "é<|endoftext|>\u0301x", "日本語テキスト" * 60, "a" * 5000, "!?" * 900]:
        same(ours, theirs, text)
    for _ in range(4000):
        same(ours, theirs, "".join(r.choice(letters) for _ in range(r.randint(0, 40))))


def test_every_code_point_equals_the_library(ours, theirs):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for frame in ("{}", "a{}a", "1{}."):
        for at in range(0, len(every), 50_000):
            texts = [frame.format(c) for c in every[at : at + 50_000]]
            bad = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)) if e.ids != ours.encode(t)]
            assert not bad, bad[:10]


def test_long_words_are_not_kept(ours):
    fresh = B.WordBpe(open(TOKENIZER, encoding="utf-8").read())
    for i in range(30):
        text = f"{i}" + "ab" * 3000
        assert fresh.encode(text) == ours.encode(text)
    assert sum(map(len, fresh.known)) < 100 and sum(map(len, fresh.known_pieces)) < 100


def test_heap_equals_scan(ours):
    r = random.Random(6)
    for _ in range(300):
        symbols = [r.choice("abcdeinrst") for _ in range(r.randint(1, 120))]
        assert ours.queue(list(symbols)) == ours.scan(list(symbols))


def test_cache_limit_changes_nothing(ours, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 3)
    fresh = B.WordBpe(open(TOKENIZER, encoding="utf-8").read())
    text = "one two three four five six one two three " * 3
    assert fresh.encode(text) == ours.encode(text) and len(fresh.known) <= 3
    monkeypatch.setattr(B, "CACHE_BYTES", 1000)
    assert fresh.encode(text) == ours.encode(text) and len(fresh.known) <= 4


def test_edges(make, awkward, empty, clashing):
    got = B.digest_documents(awkward, TOKENIZER).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == 10 and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, none, none) for r in got if r.doc_id in (1, 2, 3))
    assert B.digest_documents(empty, TOKENIZER).count() == 0 and B.digest_documents(clashing, TOKENIZER).count() == 3
    full = B.encode_documents(awkward, TOKENIZER).where("doc_id = 6").first()
    assert hashlib.sha256(struct.pack(f"<{full.n_tokens}I", *full.ids)).hexdigest() == full.ids_sha256


def test_query_equals_the_library(spark, sf, theirs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_bpe_rank_array"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_kept_word_takes_few_bytes(ours):
    """A word of one piece is held once, by its ids alone (before: its decoded text too, and the piece beside it)."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(8)) for _ in range(20_000)]
    tracemalloc.start()
    fresh = B.WordBpe(open(TOKENIZER, encoding="utf-8").read())
    began = tracemalloc.get_traced_memory()[0]
    for at in range(0, len(words), 100):
        fresh.encode_bytes(" ".join(words[at : at + 100]))
    took = tracemalloc.get_traced_memory()[0] - began
    tracemalloc.stop()
    assert len(fresh.known) == len(set(words)) and took < 300 * len(words) and took < sum(fresh.held) * 1.1
