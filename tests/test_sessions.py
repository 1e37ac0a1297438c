"""Recorded sessions: known cases of calls that void a run, and of refusals."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import corpora

CALLS = [
    ("Read", ["src/a.ts"], None, []),
    ("Write", ["src/a.ts"], None, ["tool"]),
    (None, [], None, ["tool"]),
    ("Write", ["../a"], None, ["tool", "path"]),
    ("Glob", ["src/**/../../x"], None, []),  # a glob counts up to its first wildcard
    ("Glob", ["a/../../*.ts"], None, ["path"]),
    ("Grep", ["'/etc'"], None, ["path"]),
    ("Read", ["C:\\x"], None, ["path"]),
    ("Bash", [], "git log -1 && git status;git diff", []),
    ("Bash", [], "git logs", ["command"]),
    ("Bash", [], None, ["command"]),
    ("Bash", [], " ; ", ["command"]),
    ("Bash", [], "git show HEAD:../x", []),  # down one level and up again
    ("Bash", [], "git diff --output=../../x", ["argument"]),
    ("Bash", [], "git diff --no-index a b", ["argument"]),
    ("Bash", [], "cat a | git diff ~/x", ["command", "argument"]),
    ("Read", [], "rm -rf /", []),
]


def test_voiding_names_each_case(spark):
    rows = [(i, name, paths, command) for i, (name, paths, command, _) in enumerate(CALLS)]
    calls = spark.createDataFrame(rows, "i int, name string, paths array<string>, command string")
    got = {r.i: list(r.why) for r in corpora.voiding(calls).collect()}
    assert got == {i: why for i, (*_, why) in enumerate(CALLS) if why}


def said(text, marked=True, error=None):
    return {"type": "assistant", "is_api_error_message": marked, "api_error": error, "message": {"content": [{"type": "text", "text": text}]}}


def result(**more):
    return {"type": "result", "subtype": "success", "modelUsage": {"m": {}}} | more


BAD = {"is_error": True, "result": "stopped"}
RUNS = {
    "prose": ([said("prompt is too long", marked=False), result(**BAD)], None),
    "typed": ([said("no", error="long_context_credits_required"), result(**BAD)], "long_context_credits_required"),
    "other error": ([said("no", error="overloaded"), result(**BAD)], None),
    "worded": ([said("Prompt is too long" + "." * 200), result(**BAD)], ("Prompt is too long" + "." * 200)[:120]),
    "last one": ([said("prompt is too long"), said("input is too long for requested model"), result(**BAD)], "input is too long for requested model"),
    "ended well": ([said("prompt is too long"), result()], None),
    "by result": ([result(is_error=True, result="PROMPT IS TOO LONG")], "PROMPT IS TOO LONG"),
    "no result": ([said("prompt is too long")], None),
}


@pytest.mark.parametrize("partitions", [1, 5])
def test_refusals_tokens_and_tools(spark, partitions):
    init = {"type": "system", "subtype": "init", "tools": ["Read", "Bash"]}
    rows = [(run, pos, json.dumps(e)) for run, (events, _) in RUNS.items() for pos, e in enumerate([init, *events])]
    rows.append(("ended well", 9, json.dumps(result(usage={"input_tokens": 5, "cache_creation_input_tokens": 2}))))
    lines = spark.createDataFrame(rows, "run string, pos int, line string").repartition(partitions)
    got = {r.run: r for r in corpora.run_results(lines).collect()}
    assert {k: r.size_refusal for k, r in got.items()} == {k: want for k, (_, want) in RUNS.items()}
    assert {r.tools for r in got.values()} == {"Read,Bash"} and [k for k, r in got.items() if r.ok] == ["ended well"]
    r = got["ended well"]
    assert (r.input_tokens, r.output_tokens, r.cache_write_tokens, r.cache_read_tokens) == (5, 0, 2, 0) and got["typed"].input_tokens is None
    assert corpora.run_results(lines.where(F.lit(False))).count() == 0


def test_a_replay_without_a_recording_fails(spark):
    from gristmill.sources import readers

    asked = spark.createDataFrame([("a",), ("b",)], "request_key string")
    recorded = spark.createDataFrame([("a", True), ("b", False)], "request_key string, is_vulnerable boolean")
    assert {tuple(r) for r in readers.replayed(asked, recorded).collect()} == {("a", True), ("b", False)}
    with pytest.raises(Exception, match="no recording of b"):
        readers.replayed(asked, recorded.where("request_key = 'a'")).collect()
