from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as P
from gristmill.llm import language_id, mixing, pii
from gristmill.llm.queries import TOKENIZER


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))}


def test_stages_equal_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r.asDict() for r in docs.collect()]
    stage = dict(P.STAGES)

    known = stage["language"](spark, docs, sf).cache()
    net = language_id.train(language_id.sample(docs))
    said = language_id.predict(net, [r["text"] for r in want])
    keep = [r for r, (lang, score) in zip(want, said) if lang != "und" and score >= P.LEAST_SCORE]
    assert Counter(r.doc_id for r in known.collect()) == Counter(r["doc_id"] for r in keep)

    single = stage["near_duplicates"](spark, known, sf).cache()
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in keep}
    root = {i: i for i in sets}
    changed = True
    while changed:  # all pairs, until nothing changes
        changed = False
        for a in sets:
            for b in sets:
                if root[a] > root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in root if root[i] == i)

    clean = stage["personal_data"](spark, single, sf).cache()
    for r in clean.collect():
        assert not pii.base_spans(r.text) or "<" in r.text
    assert clean.columns == docs.columns and clean.count() == single.count()

    mixed = stage["mixture"](spark, clean, sf).cache()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies})

    tokens = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = stage["tokens"](spark, mixed, sf).collect()
    assert len(out) == mixed.count()
    for r in out[:80]:
        assert list(r.ids) == tokens.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_and_empty_table(spark, sf, empty, monkeypatch):
    monkeypatch.setattr(language_id, "BATCH", 32)
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "tokens"]
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
    assert P.run(spark, sf).count() > 0


def test_awkward_rows_and_clashing_columns_pass_every_stage(spark, sf, awkward, monkeypatch):
    monkeypatch.setattr(language_id, "BATCH", 32)
    docs = awkward.selectExpr("*", "doc_id + 1 AS _row", "'x' AS _doc", "2.5 AS copies", "lang AS shard")
    columns = docs.columns
    rows = {tuple(r) for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        if name == "near_duplicates":
            kept = [tuple(r) for r in docs.collect()]
            assert set(kept) <= rows and len(kept) == len(set(kept))
    assert P.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
