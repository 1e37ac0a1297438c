from gristmill.llm import mixing as M


def water(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, free, out = 1.5 * sum(sizes.values()), list(names), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            budget -= out[s]
            free.remove(s)
    return out


def test_targets_and_copies(make):
    rows = [(i, "w " * (1 + i % 9), "en", ["a", "b", "c", "d", None][i % 5 if i % 2 else 0]) for i in range(4000)]
    got = M.mix(make(rows)).collect()
    source = {i: s for i, _, _, s in rows}
    sizes = {}
    for r in got:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = water(sizes)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken == r.size * r.copies <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) < 0.1 * want[s]
    again = {r.doc_id: r.taken for r in M.mix(make(rows).repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_edges(make, awkward, empty, clashing):
    got = M.mix(awkward).collect()
    assert len(got) == 10 and all(r.size == 0 for r in got if r.doc_id in (1, 2, 3))
    assert M.mix(empty).count() == 0 and M.mix(clashing).count() == 3
    assert [r.target for r in M.mix(make([(1, None, None, "a"), (2, "", None, "b")])).collect()] == [0.0, 0.0]


def test_repeat_emits_what_mix_counts(make, empty, clashing):
    docs = make([(i, f"some text {i}", "en", "ab"[i % 2]) for i in range(300)])
    emitted = {}
    for r in M.repeat(docs).collect():
        emitted[r.doc_id] = emitted.get(r.doc_id, 0) + 1
    assert emitted == {r.doc_id: r.copies for r in M.mix(docs).collect() if r.copies}
    assert M.repeat(docs).columns == docs.columns and M.repeat(empty).count() == 0 and M.repeat(clashing).columns == clashing.columns
