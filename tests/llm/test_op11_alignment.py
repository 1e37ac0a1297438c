import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gristmill.llm import alignment as A
from gristmill.llm.bpe import byte_letters
from gristmill.llm.queries import QUERIES, TOKENIZERS
from gristmill.runtime import table


@pytest.fixture(scope="module")
def theirs():
    a = Tokenizer.from_file(TOKENIZERS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=TOKENIZERS[1])


def whole(theirs, text):
    """(A's and B's tokens as (id, bytes)) of a whole text by the libraries, or None."""
    a, b = theirs
    byte = {c: i for i, c in enumerate(byte_letters())}
    if not text:
        return None
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == raw for side in (left, right)) else None


def ranges(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def plain(theirs, rows):
    """The contract's rows by loops over whole texts."""
    seen, docs = [], Counter()
    for i, text in rows:
        got = whole(theirs, text)
        if got is None:
            seen.append((i, None))
            continue
        a, b = map(ranges, got)
        links, k = [], 0
        for s, e, x in a:
            while b[k][1] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][0] < e:
                links.append((x, b[j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if last <= s and e <= c) for side in (a, b)) if len(cuts) < 400 else None)
            last = c
        if None in groups:  # long texts: the same in one pass
            groups, ia, ib = [], 0, 0
            for c in cuts:
                ja, jb = ia, ib
                while ja < len(a) and a[ja][1] <= c:
                    ja += 1
                while jb < len(b) and b[jb][1] <= c:
                    jb += 1
                groups.append(",".join(str(x[2]) for x in a[ia:ja]) + "|" + ",".join(str(x[2]) for x in b[ib:jb]))
                ia, ib = ja, jb
        seen.append((i, (len(a), len(b), groups, links)))
        docs.update(set(links))
    top = {}
    for (a, _), n in docs.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, x in seen:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = x
            out.append((i, na, nb, len(groups), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_over_the_table_equals_plain_loops(spark, sf, theirs):
    got = QUERIES["op11_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == plain(theirs, [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()])


def test_many_blocks_and_shuffled_counts_equal_plain_loops(spark, sf, theirs, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 30_000)
    monkeypatch.setattr(A, "PAIRS", 0)
    docs = table(spark, sf, "documents").where("doc_id < 60")
    assert rows(A.align(docs, *TOKENIZERS)) == plain(theirs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_cells_have_the_tokens_of_whole_texts(theirs):
    r = random.Random(8)
    ours = A.Both(open(TOKENIZERS[0], encoding="utf-8").read(), open(TOKENIZERS[1], "rb").read())
    letters = [*"aZ9 .,'-#\t\n\r", "  ", "   ", " the", " 's", "é", "ß", "Ω", "ж", "日", "한", " ", "　", " ", "́", "\x00", "\x1c", "​", "\U0001f600", "▁", "<s>", "<|endoftext|>", "<0x41>", "͸", " ", "ﬁ"]
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        cells = A.cells_of(text)
        assert "".join(cells) == " " + text
        want = whole(theirs, text)
        got = ours.encode(cells).to_pylist()
        if want is None:
            assert any(not c["a"] for c in got), repr(text)
        else:
            for k, side in enumerate(("a", "b")):
                assert [(t & (1 << A.LENGTH_BIT) - 1, t >> A.LENGTH_BIT) for c in got for t in c[side]] == [(i, len(x)) for i, x in want[k]], repr(text)


def test_spark_cuts_cells_as_python_does(spark):
    from pyspark.sql import functions as F

    texts = ["", " ", "a b", "a  b c ", "é ñ  x", "日 本 　 한", "͸ x y", "\x1c a\n b", "x\U0001f600 y", "a" * 50 + " b", "́ a ́b"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.split(F.concat(F.lit(" "), F.col("text")), A.CELLS, -1).alias("cells")).collect()
    assert [r["cells"] for r in got if r["text"]] == [A.cells_of(t) for t in texts if t]


def test_edges(spark, theirs, awkward, empty, clashing, make):
    assert rows(A.align(awkward, *TOKENIZERS)) == plain(theirs, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert rows(A.align(empty, *TOKENIZERS)) == []
    assert rows(A.align(clashing, *TOKENIZERS)) == plain(theirs, [(r["doc_id"], r["text"]) for r in clashing.collect()])
    hard = make([(1, "日本語" * 3000), (2, "x" * 9000), (3, "a▁b"), (4, "a b  "), (4, "a b  "), (5, "<s> </s> <|endoftext|> <unk>"), (6, "   "), (7, "a▁b c")])
    assert rows(A.align(hard, *TOKENIZERS)) == plain(theirs, [(r["doc_id"], r["text"]) for r in hard.collect()])


def test_documents_are_read_once_and_no_text_is_shuffled(spark, sf):
    docs = table(spark, sf, "documents")
    again = A.align(docs, *TOKENIZERS)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in again and "documents" not in again
    kept = A.blocks_of(docs, *TOKENIZERS).selectExpr("sum(length(docs) + length(links)) AS n").first()["n"]
    assert kept < docs.selectExpr("sum(octet_length(text)) AS n").first()["n"]


def test_a_cell_that_one_tokenizer_changes_has_no_tokens(theirs):
    both = A.Both(open(TOKENIZERS[0], encoding="utf-8").read(), open(TOKENIZERS[1], "rb").read())
    got = both.encode([" a", " a\u2581b", " ﬁ", "", " bc"]).to_pylist()
    assert [bool(c["a"]) for c in got] == [bool(whole(theirs, t)) for t in ("a", "a\u2581b", "ﬁ", "", "bc")]
