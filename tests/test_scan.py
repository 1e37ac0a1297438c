"""Whole scans: gates that the registered queries don't turn, registry order, and plans."""

import os
import shutil
import subprocess
import sys

from gristmill.operators import pairing, scan
from gristmill.plans import composed_queries, stand_ins


def test_literal_tier_waits_for_verdicts_when_validated(spark):
    rows = scan.asked(stand_ins.snippets(spark), tuple(d for d in scan.REGISTRY if d.family == "admin-check")).cache()
    none = composed_queries.recorded(rows).limit(0)
    literal = rows.where("tier = 'literal'").count()
    free = scan.judged(rows, none)
    assert literal and free.where("bypassed AND outcome = 'emitted'").count() == literal == free.where("outcome = 'emitted'").count()
    assert scan.judged(rows, none, validate=True).where("outcome <> 'unjudged'").count() == 0


def test_registry_order_decides_between_findings(spark):
    found = spark.createDataFrame([(5, 0, "a.ts", 3, "idor_risk", "idor-x"), (0, 0, "a.ts", 3, "auth_bypass_risk", "r"), (5, 1, "a.ts", 3, "idor_risk", "idor-y"), (1, 2, "a.ts", 3, "auth_bypass_risk", "late")], "place int, pair_index int, path string, start_line int, type string, rule_id string")
    assert sorted(r.rule_id for r in scan.united(found).collect()) == ["idor-x", "r"]


def test_nearest_sources_need_no_join_of_hits(spark):
    hits = spark.createDataFrame([("p", r, f"{r}{n}", 0, n, n) for n in (1, 150, 9_950, 10_060, 30_000) for r in ("source", "sink") if n != 10_060 or r == "sink"], "path string, role string, pattern_id string, ord int, pos int, line int")
    got = {r.sink_line: (r.source_line, r.distance) for r in pairing.nearest_pairs(hits).collect()}
    assert got == {1: (1, 0), 150: (150, 0), 9_950: (9_950, 0), 10_060: (9_950, 110), 30_000: (30_000, 0)}  # 10,060 lies in the strip after 9,950's
    plan = pairing.nearest_pairs(hits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0


def test_the_rest_works_without_the_training_data_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [n for n in q if n.startswith('op1')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_counted_hits_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks follow the number of hits, with the same pairs."""
    monkeypatch.setattr(pairing, "LINES", 50)
    hits = spark.range(1000).selectExpr("id % 7 AS path", "if(id % 3 = 0, 'sink', 'source') AS role", "0 AS ord", "id AS pos", "cast(id * 13 % 900 AS int) AS line", "'p' AS pattern_id")
    dealt = pairing.nearest_pairs(hits, counted=1000)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, pairing.nearest_pairs(hits).collect()))
    assert "hashpartitioning(path, _strip, 20)" in " ".join(__import__("re").sub(r"#\d+L?", "", dealt._jdf.queryExecution().executedPlan().toString()).split())
