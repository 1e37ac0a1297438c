import random
import re

import numpy as np

from gristmill.llm import pii as P
from gristmill.llm.scan import joined, sha256

EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]


def test_base_spans_equal_leftmost_search():
    r = random.Random(4)
    bits = [*"0123456789", ".", ".", "@", "a", "a.b", "+", "+1", "-", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "\n", "é", "٣", "255", "256", "%", "  "]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 22)))
        assert sorted(P.base_spans(text)) == sorted(brute(text)), text


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "a@b" * 60_000):
        P.base_spans(text)


def test_messages_equal_enumeration_on_a_tree(monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 60)  # to the fixed point, which is exact without cycles
    f = P.Field()
    r = np.random.default_rng(0)
    f.w = {k: r.normal(size=w.shape) * 0.5 for k, w in f.w.items()}
    f.w["f"][-1] = 0  # the padding has no weight
    g = P.Graph(spans=[(0, 0, 1)] * 4, features=[[0, 1], [2], [3, 4], [5]], chain=[(0, 1), (1, 2)], skip=[(1, 3)])
    nodes, pairs = f.marginals(*f.arrays(g))
    own = np.array([f.w["f"][x].sum(axis=0) for x in g.features])
    total, want = 0.0, np.zeros((4, P.K))
    for y in np.ndindex(*(P.K,) * 4):
        p = np.exp(sum(own[i, y[i]] for i in range(4)) + f.w["chain"][y[0], y[1]] + f.w["chain"][y[1], y[2]] + f.w["skip"][y[1], y[3]])
        total += p
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(nodes, want / total, atol=1e-4) and np.allclose(pairs.sum(axis=(1, 2)), 1)


def test_field_adds_what_the_pattern_loses_and_leaves_decoys():
    words = ["the", "call", "at", "from", "old", "is", "it"]
    r = random.Random(7)
    some = lambda: " ".join(r.choice(words) for _ in range(4))
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    texts = [f"{some()} {r.choice([phone(), f'{r.randint(1, 255)}.{r.randint(1, 255)}.7.9', f'a{i}@mail.test', str(r.randint(10**15, 10**16))])} {some()}" for i in range(400)]
    field = P.train(texts)
    merged = f"{some()} {phone()} 170.106.47.218 {some()}"
    assert not any(k == "phone" for k, _, _ in P.base_spans(merged))
    (base, more), (_, none) = P.find(field, [merged, "licence version 2.0 of 2024 is free"])
    assert [k for k, _, _ in more] == ["phone"] and none == []


def test_redaction():
    text = "mail a@b.cd or +1 (234) 555-6789, 4111111111111111"
    assert P.redacted(text, P.base_spans(text)) == "mail <EMAIL> or <PHONE>, <CARD>"
    assert P.redacted("plain", []) == "plain"


def test_edges(make, awkward, empty, clashing):
    got = P.find_personal_data(awkward).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert P.find_personal_data(empty).count() == 0 and P.find_personal_data(clashing).count() == 3
    out = {r.doc_id: r for r in P.redact(make([(1, "é a@b.cd"), (2, None), (3, "clean"), (3, "clean")])).collect()}
    assert out[1].text == "é <EMAIL>" and out[1].n_chars == 9 and out[2].text is None and out[3].text == "clean"
    assert P.redact(clashing).columns == clashing.columns and P.redact(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    from gristmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_skip_chain_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256(joined(base, P.KINDS)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in P.KINDS)
        assert set(filter(None, joined(base, P.KINDS).split(","))) <= set(r.spans.split(","))
