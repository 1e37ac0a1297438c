"""Planned scores, two readings of reach, and selections against plain loops."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gristmill.operators import experiments, pairing


def test_planned_scores_against_a_loop(spark):
    r = random.Random(5)
    targets, verdicts = [], []
    for series in range(12):
        lossy = series % 3 == 0
        for kind in ("held-out", "development", "clean"):
            for case in range(6):
                for path in ("a", "b"):
                    for side in ("parent", "fix"):
                        if side == "fix" and r.random() < 0.1:
                            continue
                        targets.append((series, kind, f"c{case}", side, path))
                        runs = r.choice([0, 4, 5, 6]) if lossy and r.random() < 0.05 else 5
                        chance = 0.95 if side == "parent" and kind != "clean" else series / 14
                        verdicts += [(series, kind, f"c{case}", side, path, k, r.random() < chance) for k in range(runs)]
    t = spark.createDataFrame(targets, "series int, set string, case string, side string, path string")
    v = spark.createDataFrame(verdicts, "series int, set string, case string, side string, path string, run int, emitted boolean")
    n, hits = Counter(x[:5] for x in verdicts), Counter(x[:5] for x in verdicts if x[6])
    want = {}
    for series in range(12):
        mine = [x for x in targets if x[0] == series]
        whole = all(n[x] == 5 for x in mine)
        cases = {}
        for x in mine:
            if x[1] == "held-out" and x[3] == "parent":
                fix = (*x[:3], "fix", x[4])
                cases[x[2]] = cases.get(x[2], False) or (fix in mine and n[x] == n[fix] == 5 and hits[x] >= 4 and hits[fix] <= 1)
        clean, fixed = sum(x[1] == "clean" and hits[x] >= 4 for x in mine), sum(x[3] == "fix" and hits[x] >= 4 for x in mine)
        found = sum(cases.values())
        recall = "INCOMPLETE" if not whole else "PASS" if found >= 4 else "FAIL" if found <= 1 else "INCONCLUSIVE"
        want[series] = (whole, len(cases), found, clean, fixed, recall, "INCOMPLETE" if not whole else "TOO NOISY" if clean > 3 else "ok")
    got = {x.series: (x.complete, x.cases, x.hits, x.clean_flags, x.fix_flags, x.recall, x.noise) for x in experiments.planned_scores(t, v, 5, ["series"]).collect()}
    assert got == want and {"INCOMPLETE", "PASS", "FAIL"} <= {x[5] for x in want.values()}


def test_two_readings_of_reach_agree_and_differences_show(spark):
    r = random.Random(9)
    rows = [(f"f{f}", r.choice(["source", "sink"]), "p", 0, k, r.randint(1, 3000)) for f in range(150) for k in range(r.randint(0, 6))]
    hits = spark.createDataFrame(rows, "path string, role string, pattern_id string, ord int, pos int, line int")
    files = spark.createDataFrame([(f % 7, f"f{f}", "gone" if f == 3 else None) for f in range(150)], "repo int, path string, error string")
    close = {a[0] for a in rows for b in rows if a[0] == b[0] and a[1] == "source" and b[1] == "sink" and abs(a[5] - b[5]) <= 200}
    pairs = pairing.nearest_pairs(hits)
    got = {x.path: x.outcome for x in experiments.reach_outcomes(files, hits, pairs, 200).collect()}
    assert got == {f"f{f}": "failed" if f == 3 else "both" if f"f{f}" in close else "none" for f in range(150)} and len(close) > 20
    one = sorted(close - {"f3"})[0]
    odd = experiments.reach_outcomes(files, hits, pairs.where(F.col("path") != one), 200)
    assert [x.path for x in odd.where("outcome = 'predicted only'").collect()] == [one]
    nearer = experiments.reach_outcomes(files, hits, pairs, 20)
    assert nearer.where("outcome = 'real only'").count() > 0
    total = experiments.reach_totals(odd).first()
    assert (total.repos, total.files, total.failed, total.disagreements, total.agreed) == (7, 150, 1, 1, False)
    none = experiments.reach_totals(odd.where("repo < 0")).first()
    assert (none.repos, none.files, none.disagreements) == (0, 0, 0)


def test_selection_order_and_tally(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 60), r.choice("abcd") if r.random() < 0.95 else None, r.choice([None, None, None, "old"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "id int, kind string, reason string").repartition(5)
    first = {}
    for i, kind, reason in rows:
        if reason is None:
            first[i] = min(first.get(i, ("z",)), (kind or "",))
    kept = sorted((sorted(i for i in first if first[i] == k).index(i) + 1, k, i) for i, k in first.items())
    kept = [(i, k[0] or None) for rank, k, i in kept if rank <= 4]
    got = experiments.stratified(df.where("reason IS NULL"), "id", ["kind"], 4).collect()
    assert [(x.id, x.kind) for x in sorted(got, key=lambda x: x.position)] == kept and [x.position for x in got] == list(range(1, len(kept) + 1))
    want = Counter((k, "kept") for _, k in kept)
    want += Counter((k, reason) for _, k, reason in rows if reason)
    for kind in {k for _, k, _ in rows}:
        mine, once = sum(k == kind and not x for _, k, x in rows), sum(f[0] == (kind or "") for f in first.values())
        want[kind, "repeated"], want[kind, "surplus"] = mine - once, max(once - 4, 0)
    tally = experiments.selection_tally(df, "id", ["kind"], 4, F.col("reason")).collect()
    assert {(x.kind, x.outcome): x.n for x in tally} == {k: n for k, n in want.items() if n}
