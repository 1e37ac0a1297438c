import zlib

import numpy as np

from gristmill.llm import language_id as L


def test_gradients_equal_differences():
    net = L.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    rows, labels = r.integers(1, 200, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    rows[2, 6:] = 0
    _, g = net.gradients(rows, labels)
    for k, w in net.w.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in w.shape)
            at = (at[0], at[1], int(rows[0, 3])) if k == "x" else at
            old, step = w[at], 1e-2
            w[at] = old + step
            up = net.gradients(rows, labels)[0]
            w[at] = old - step
            down = net.gradients(rows, labels)[0]
            w[at] = old
            assert abs(g[k][at] - (up - down) / 2 / step) < 1e-4


def test_held_out_accuracy_and_determinism(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.learn_and_identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    texts = [r.text for r in got[:40]]
    examples = [(r.lang, r.text[:200].encode()) for r in got if not r.held_out][:200]
    assert L.predict(L.train(examples, steps=5), texts) == L.predict(L.train(examples, steps=5), texts)


def test_windows_hold_the_whole_text():
    data = bytes(range(1, 201))
    assert L.windows(data).tobytes().rstrip(b"\0") == data and len(L.windows(b"")) == 0


def test_edges(spark, make, awkward, empty, clashing, monkeypatch):
    monkeypatch.setattr(L, "BATCH", 16)  # small steps: the answers here don't depend on skill
    got = {r.doc_id: r for r in L.learn_and_identify(awkward).collect()}
    assert L.learn_and_identify(awkward).count() == 10
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[None].held_out is False and got[4].lang_pred in ("en", "de")
    assert L.learn_and_identify(empty).count() == 0
    assert {r.lang_pred for r in L.learn_and_identify(make([(1, "words", None, "s")])).collect()} == {"und"}
    assert L.learn_and_identify(clashing).count() == 3
    net = L.train(L.sample(clashing))
    kept = L.keep_known(clashing, net, 0.5)
    assert kept.columns == clashing.columns and kept.count() == 3
    assert L.keep_known(awkward, net, 0.5).where("text is null").count() == 0
    assert L.predict(net, ["123 456", None, "a"])[:2] == [("und", 0.0)] * 2


def test_sample_is_bounded_and_leaves_the_fold_out(spark, make):
    rows = [(i, f"text number {i}", "en" if i % 2 else "de", "s") for i in range(3000)]
    got = L.sample(make(rows))
    assert len(got) == 2 * L.PER_LANGUAGE
    held = {f"text number {i}".encode() for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & {t for _, t in got}
