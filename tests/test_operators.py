"""Diffs, globs, rewrites, findings, sinks, readers and streams."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions.globs import glob_regex, ignore_regexes
from gristmill.functions.text import clip_utf8
from gristmill.operators import diffs, experiments, findings, history, routes, sqli
from gristmill.sources import readers, sinks
from gristmill.streaming import events

HEADER = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def loop(diff):
    """(path, content, line map, changed lines) of each part, line by line."""
    out = []
    for part in re.split(r"(?m)^diff --git ", diff):
        if not part.strip():
            continue
        path, text, at, chain, one, inside, run, changed = None, [], [], 0, 0, False, False, set()
        for line in re.split(r"\r?\n", part):
            if line.startswith("+++ b/"):
                path = line[6:].strip()
            elif line.startswith("@@"):
                m, inside, run = HEADER.match(line), True, False
                chain, one = (int(m[1]),) * 2 if m else ((at[-1] + 1 if at else 1), 1)
            elif inside and line.startswith("+") and not line.startswith("+++"):
                text.append(line[1:])
                at.append(chain)
                changed.add(one)
                chain, one, run = chain + 1, one + 1, False
            elif inside and line.startswith("-"):
                if not run:
                    changed.add(max(1, one))
                run = True
            elif inside and not line.startswith("\\"):
                chain, one, run = chain + 1, one + 1, False
        out.append((path, "\n".join(text), at, sorted(changed)))
    return out


def test_diffs_equal_loop(spark):
    r, rows = random.Random(9), []
    kinds = ["+a", "+b", "-c", "-d", " e", "", "\\ No newline at end of file", "@@ -1,2 +7,3 @@ f", "@@ -3 +0,0 @@", "@@ bad @@", "+++ b/other.ts ", "+++plus", "--- a/x", "--gone"]
    for i in range(60):
        parts = ["diff --git a/p b/p\n" + ("+++ b/p.ts\n" if r.random() < 0.9 else "") + "\n".join(r.choice(kinds) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 3))]
        rows.append((i, "\n".join(parts) + "\n"))
    df = spark.createDataFrame(rows, "scan_id int, diff string")
    got = {}
    for x in diffs.parse(df).orderBy("scan_id", "part").collect():
        got.setdefault(x.scan_id, []).append((x.path, x.content, x.line_map))
    changed = {}
    for x in diffs.changed_lines(df).orderBy("scan_id", "part").collect():
        changed.setdefault(x.scan_id, []).append((x.path, x.changed))
    for i, diff in rows:
        want = loop(diff)
        assert got.get(i, []) == [(p, c, m) for p, c, m, _ in want if p and m], diff
        assert changed.get(i, []) == [(p, ch) for p, _, _, ch in want if p and ch], diff


def test_synthetic_diff_round_trip(spark):
    rows = [(1, "a.ts", "x\ny\n\nz\n\n"), (2, "b/c.py", "one line"), (3, "d.go", "+++ plus\n--- minus\n@@ odd")]
    df = spark.createDataFrame(rows, "scan_id int, path string, content string")
    back = diffs.parse(df.select("scan_id", diffs.synthetic(F.col("path"), F.col("content")).alias("diff"))).collect()
    got = {r.scan_id: (r.path, r.content, r.line_map) for r in back}
    assert got[1] == ("a.ts", "x\ny\n\nz", [1, 2, 3, 4]) and got[2] == ("b/c.py", "one line", [1]) and got[3][2] == [2, 3]  # a line of the file that starts with ++ is not collected, but counts
    line = spark.createDataFrame([(2, [5, 9]), (3, [5, 9]), (0, [5])], "n int, m array<int>").select(diffs.remap(F.col("n"), F.col("m")).alias("x")).collect()
    assert [r.x for r in line][:2] == [9, 3]


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts", "src/.h/a.ts"], ["a.ts", "src/a.tsx", "lib/src/a.ts"]), ("*.js", ["a.js", ".a.js"], ["x/a.js"]), ("**/{a,b}/*.py", ["a/x.py", "q/b/x.py"], ["c/x.py"]), ("docs/**", ["docs/a/b"], ["doc/a"]), ("f?[0-9].c", ["fa1.c"], ["f1.c", "fab.c"]), ("a+b(c).ts", ["a+b(c).ts"], ["aab(c).ts"]),
])
def test_globs(glob, yes, no):
    rx = re.compile(glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


def test_ignore_file():
    rules, negated = ignore_regexes("# c\n\nlogs/\n*.tmp\n/root.txt\na/b\n!keep\n")
    hit = lambda p: any(re.search(x.replace(r"\z", r"\Z"), p) for x in rules)
    assert negated == ["!keep"]
    assert all(map(hit, ["logs/x", "q/logs/x", "x.tmp", "q/x.tmp", "root.txt", "a/b", "a/b/c"])) and not any(map(hit, ["logs", "q/root.txt", "x/a/b", "keep"]))


@pytest.mark.parametrize(("code", "dialect", "want"), [
    ("'SELECT * FROM t WHERE a = ' + a + ' AND b = ' + b", "postgres", ("concat", "'SELECT * FROM t WHERE a = $1 AND b = $2'", ["a", "b"], "high")),
    ("db.query('SELECT * FROM t WHERE id = ' + id)", "mysql", ("concat", "db.query('SELECT * FROM t WHERE id = ?')", ["id"], "high")),
    ("`SELECT ${a} FROM t`", "postgres", ("template", "`SELECT $1 FROM t`", ["a"], "medium")),
    ("'a' + 'b'", "mysql", ("fallback", "'a' + 'b'", [], "low")),
    ("q = 'SELECT 1'+x", "mysql", ("fallback", "q = 'SELECT 1'+x", [], "low")),
])
def test_rewrites(code, dialect, want):
    assert sqli.rewrite(code, dialect) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["SELECT a", "WHERE b = ", " AND c = "]), min_size=1, max_size=4), st.sampled_from(["postgres", "mysql"]))
def test_rewrite_binds_every_value_once(parts, dialect):
    code = " + ".join(f"'{p}' + v{i}" for i, p in enumerate(["SELECT x FROM t WHERE ", *parts]))
    mode, fixed, values, _ = sqli.rewrite(code, dialect)
    marks = re.findall(r"\$[0-9]+", fixed) if dialect == "postgres" else re.findall(r"\?", fixed)
    assert mode == "concat" and len(marks) == len(values) and len(set(values)) == len(values)


def test_grading(spark):
    rows = [(1, "concat", "'a = ?'", ["x"], "high", "mysql"), (2, "concat", "'a = ? ?'", ["x"], "high", "mysql"), (3, "template", "`x LIKE '%$1%'`", ["a"], "medium", "postgres"), (4, "fallback", "x", [], "low", "mysql"), (5, "template", "`$1 $2`", ["a", "b"], "high", "postgres"), (6, "concat", "x", ["a"], "medium", "mysql")]
    df = spark.createDataFrame(rows, "id int, mode string, fixed string, params array<string>, confidence string, dialect string")
    got = {r.id: (r.quality, len(r.warnings)) for r in sqli.graded(df).collect()}
    assert got == {1: ("high", 0), 2: ("medium", 1), 3: ("medium", 2), 4: ("low", 1), 5: ("high", 0), 6: ("medium", 0)}


def test_changed_line_window_edges(spark):
    f = spark.createDataFrame([("p", 100, 110, n) for n in range(6)] + [("missing", 1, 1, 9), ("none", 1, 1, 8)], "path string, start_line int, end_line int, n int")
    for line, want in ((94, False), (95, True), (150, True), (151, False)):
        changed = spark.createDataFrame([("p", [line]), ("none", [])], "path string, changed array<int>")
        got = {r.n: r.introduced for r in findings.partition_by_change(f, changed, ["path"]).collect()}
        assert got[0] is want and got[9] is True and got[8] is False


def test_state_fold_and_rates(spark):
    rows = [("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "completed"), ("a", 4, "failed"), ("b", 1, "pending"), ("b", 2, "retrying"), ("b", 3, "running"), ("c", 1, "pending")]
    got = {r.run_id: r.state for r in history.fold_states(spark.createDataFrame(rows, "run_id string, seq int, state string")).collect()}
    assert got == {"a": "completed", "b": "retrying", "c": "pending"}
    n = spark.createDataFrame([(0, 0), (2, 43), (5, 5)], "k int, n int")
    from gristmill.functions.text import wilson

    low = [round(r.x, 3) for r in n.select(wilson(F.col("k"), F.col("n"), False).alias("x")).collect()]
    assert low == [0.0, 0.013, 0.566]


def test_mount_chains_and_calls(spark):
    mounts = spark.createDataFrame([("app", "a", "/a/"), ("a", "b", "b"), ("x", "y", "/y"), ("y", "x", "/x")], "parent string, child string, prefix string")
    got = sorted((r.receiver, r.prefix, tuple(r.through)) for r in routes.chains(mounts).collect())
    assert ("b", "/a/b", ("app", "a")) in got and ("a", "/a/", ("app",)) in got and len(got) == 4
    calls = spark.createDataFrame([("h", "f"), ("f", "g"), ("g", "k"), ("k", "z"), ("g", "h")], "caller string, callee string")
    starts = spark.createDataFrame([(1, "h")], "route_id int, handler string")
    assert sorted((r.symbol, r.depth) for r in routes.called(calls, starts).collect()) == [("f", 1), ("g", 2), ("k", 3)]


def test_sinks(spark):
    rows = [(1, f"src/{i}.ts", i + 1, "idor_risk" if i % 2 else "auth_bypass_risk", 'say "hi"\n' + "x" * 300, "high" if i % 3 else "low", i % 4 != 0) for i in range(60)]
    f = spark.createDataFrame(rows, "scan_id int, path string, start_line int, type string, message string, severity string, introduced boolean")
    log = json.loads(sinks.result_log(f, F.lit(True)).first().sarif)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and len(run["results"]) == 60 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["auth_bypass_risk", "idor_risk"] and run["invocations"][0]["executionSuccessful"] is False
    c = sinks.comments(f).first()
    assert (c.new, c.old) == (45, 15) and "…and 35 more" in c.comment and "…and 5 more" in c.comment and c.comment.endswith(sinks.MARKER)
    text = clip_utf8("é" * 40_000 + sinks.MARKER, sinks.COMMENT_BYTES, sinks.MARKER, sinks.NOTICE)
    assert len(text.encode()) <= sinks.COMMENT_BYTES and text.endswith(sinks.MARKER) and sinks.NOTICE in text
    bare = clip_utf8("word " * 20_000, sinks.COMMENT_BYTES, sinks.MARKER, sinks.NOTICE)
    assert bare.startswith("word word") and bare.endswith(f"{sinks.NOTICE}\n\n{sinks.MARKER}\n") and f" {sinks.NOTICE}" not in bare and sinks.COMMENT_BYTES - 80 <= len(bare.encode()) <= sinks.COMMENT_BYTES - 60
    body = spark.createDataFrame([("a.ts", 2, "w|y", "medium", "x\n\n``` code\nlast")], "path string, line int, why string, severity string, content string")
    md = sinks.report_lines(body).first().markdown
    assert "````\n``` code\nlast\n````" in md and r"w\|y" in md


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("line\n")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "node_modules/c.ts").write_text("no")
    got = readers.directory(spark, str(tmp_path)).collect()
    assert [(r.path, r.content) for r in got] == [("src/a.ts", "line\n")]
    rec = {"key": "k", "meta": {"detectorId": "idor"}, "response": {"toolInput": json.dumps({"verdicts": [{"pairIndex": 1, "isVulnerable": True, "confidence": "high"}]})}}
    flat = {"key": "q", "meta": {"detectorId": "env"}, "response": {"toolInput": json.dumps({"isVulnerable": False, "confidence": "low"})}}
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/1.json").write_text(json.dumps(rec))
    (tmp_path / "rec/2.json").write_text(json.dumps(flat))
    recorded = readers.recordings(spark, str(tmp_path / "rec"))
    assert sorted((r.request_key, r.pair_index, r.is_vulnerable) for r in recorded.collect()) == [("k", 1, True), ("q", 0, False)]
    asked = spark.createDataFrame([("k",), ("z",)], "request_key string")
    assert [r.request_key for r in readers.missing_recordings(asked, recorded).collect()] == ["z"]
    (tmp_path / "m.tsv").write_text("# c\nset\tcase\nx\t1\n")
    assert readers.manifest(spark, str(tmp_path / "m.tsv"), "`set` string, `case` int").collect()[0]["case"] == 1
    f = spark.createDataFrame([("a.ts", "// ASSUMED-PATH: src/x.ts\nbody"), ("a.ts.guard", "g"), ("b.ts", "plain")], "path string, content string")
    p, c = readers.assumed_path(F.col("path"), F.col("content"))
    assert {(r.p, r.c) for r in f.select(p.alias("p"), c.alias("c")).collect()} >= {("src/x.ts", "body"), ("b.ts", "plain")}
    side = {r.path: r.sidecars for r in readers.with_sidecars(f, {".guard": "guard"}).collect()}
    assert side == {"a.ts": {"guard": "g"}, "b.ts": None}
    log = spark.createDataFrame([("@@" + "a" * 40 + '\nx.ts\n"q.ts"\n\n@@bad\ny.ts\n',)], "text string")
    assert sorted((r.path, r.bad_sha, r.quoted) for r in readers.commit_log(log).collect()) == [('"q.ts"', False, True), ("x.ts", False, False), ("y.ts", True, False)]


def limited(rows, most, seconds):
    out, state = {}, {}
    for user, ts, i in sorted(rows):
        start, used = state.get(user, (None, 0))
        if start is None or (ts - start).total_seconds() >= seconds:
            start, used = ts, 0
        state[user] = (start, used + 1)
        out[i] = used + 1 <= most
    return out


def test_streams_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    rows = [(r.user_id, r.ts, r.event_id) for r in e.collect()]
    want = limited(rows, 2, 86_400)
    assert {r.event_id: r.allowed for r in events.limit_rate(e, most=2, seconds=86_400).collect()} == want
    path = str(tmp_path / "in")
    e.withColumn("delivery_id", F.concat(F.lit("d"), (F.col("event_id") % 300).cast("string"))).repartition(1).sortWithinPartitions("ts").write.parquet(path)
    schema = "event_id long, ts timestamp, user_id long, event_type string, delivery_id string"
    once = events.drain(events.deliver_once(events.event_stream(spark, path, schema), late="400 days"), "once")
    assert once.count() == once.select("delivery_id").distinct().count() == 300
    got = events.drain(events.limit_rate_stream(events.event_stream(spark, path, schema), most=2, seconds=86_400, late="400 days"), "limited")
    assert got.where("allowed").count() == sum(want.values()) and got.count() == len(want)
    runs = tmp_path / "runs"
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "running"), ("b", "2024-01-01 00:00:00", "running"), ("b", "2024-01-01 00:05:00", "completed")], "run_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(runs))
    spark.createDataFrame([("c", "2024-01-01 02:00:00", "completed")], "run_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(runs))
    src = events.event_stream(spark, str(runs), "run_id string, ts timestamp, state string")
    stale = events.drain(events.stale_runs_stream(src.withColumn("run_id", F.conv(F.hex("run_id"), 16, 10).cast("long"))), "stale")
    assert [(r.run_id, str(r["last"]), r.status) for r in stale.collect()] == [(97, "2024-01-01 00:00:00", "running")]  # "a" as a number


def test_draw_is_reproducible(spark):
    rows = spark.range(200).selectExpr("id", "id % 3 AS g")
    a = experiments.draw(rows, "s", F.col("id").cast("string"), ["g"], 5).collect()
    b = experiments.draw(rows.repartition(9), "s", F.col("id").cast("string"), ["g"], 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 15


def test_optional_parts_can_go():
    """Nothing outside the subpackage imports it, and the entry module works without it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in [*(root / "gristmill").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "gristmill.llm" not in path.read_text() or path.name == "test_operators.py", path


def test_calls_are_not_dealt_by_their_few_models(spark):
    from gristmill.operators import history

    calls = spark.range(1000).selectExpr("id", "IF(id < 990, 'm', 'other') AS model", "1 AS input_tokens", "1 AS output_tokens", "0 AS cache_write_tokens", "0 AS cache_read_tokens")
    got = history.call_cost(calls, spark.createDataFrame([("m", 2.0, 3.0)], "model string, input_usd double, output_usd double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert got.selectExpr("round(sum(cost_usd) * 1e6)").first()[0] == 990 * 5
