import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions.catalog import patterns
from gristmill.functions.literals import may_match, required
from gristmill.operators import matching, pairing
from gristmill.plans import stand_ins as S

FAMILIES = ("auth-bypass", "secrets-exposure", "webhook-unverified", "env-exposure", "admin-check", "idor")


@pytest.mark.parametrize(
    "regex, want",
    [
        (r"\bjwt\.verify\s*\(", (("jwt.verify",), False)), (r"(?:upsert|deleteMany)\(", (("upsert", "deleteMany"), False)), (r"(?i)token\s*=\s*PUBLIC", (("public",), True)), (r"(?:ab)?cdef", (("cdef",), False)),
        (r"(?:xyz)+1", (("xyz",), False)), (r"(?:xyz)*1", None), (r"[a-z]+", None), (r"(?:abc|[xy])", None), (r"ab|cd", None), (r"(?<bad", None), ("(?i)größe", None), (r"a(?:bcd)e", (("abcde",), False)), (r"a(bcd)e", (("bcd",), False)),
    ],
)
def test_required(regex, want):
    assert required(regex) == want


def test_every_match_holds_a_required_literal():
    """Texts cut and mixed from the snippets: whatever matches has a literal."""
    r = random.Random(2)
    pieces = [line for _, content in S.SNIPPETS for line in re.split(r"(?<=\n)|(?<=\()|(?<= )", content)]
    every = [p.regex for f in FAMILIES for p in patterns(f)]
    assert sum(required(x) is not None for x in every) > 0.75 * len(every)
    hits = 0
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 25)))
        text = text.upper() if r.random() < 0.1 else text
        for regex in every:
            known = required(regex)
            if known and re.search(regex.replace(r"\z", r"\Z"), text, re.ASCII):
                hits += 1
                assert any(x in (text.lower() if known[1] else text) for x in known[0]), (regex, text)
    assert hits > 1000


def test_prefilter_in_spark(spark):
    rows = spark.createDataFrame([("a jwt.verify(x",), ("TOKEN = Public",), ("nothing",), (None,)], "t string")
    got = rows.select(may_match(F.col("t"), F.lower("t"), r"jwt\.verify\("), may_match(F.col("t"), F.lower("t"), "(?i)token = public"), may_match(F.col("t"), F.lower("t"), "[a-z]+")).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, True, True), (False, False, True), (None, None, True)]


def searches(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {n: plan.count(n + "(") for n in ("regexp_extract_all", "split", "regexp_instr")}


def test_each_pattern_is_searched_for_once(spark):
    files, idor = S.snippets(spark), patterns("idor")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    spark.conf.set("spark.sql.maxPlanStringLength", 50_000_000)
    hits = matching.all_hits(files, idor)
    assert searches(hits)["regexp_extract_all"] == len(idor)
    assert searches(pairing.nearest_pairs(hits))["regexp_extract_all"] == len(idor)
    early = patterns("admin-check")
    assert searches(matching.earliest_hit(files, early).select("hit.pos"))["regexp_instr"] == len(early)


@pytest.mark.parametrize(
    "regex, want",
    [
        (r"@\w+\.(?:get|post)\s*\(", ((".get", ".post"), False)), (r"\b(?:session|db)\.get\b\s*\(", ((".get",), False)), (r"new [Ww]eb", (("new W", "new w"), False)),
        (r"x+\.(?:get|use)\(|\bapp\.use\(", ((".get", ".use"), False)), (r"(?:a|b|c|d)(?:e|f|g|h)xyz", (("xyz",), False)),
    ],
)
def test_neighbours_are_one_literal(regex, want):
    assert required(regex) == want


def test_route_definitions_have_literals():
    """The dearest pattern: without literals it was searched for in every line and content."""
    assert all(required(p.regex) for f in ("auth-bypass", "admin-check") for p in patterns(f))


def test_contents_without_any_literal_are_not_cut_into_lines(spark):
    files = spark.createDataFrame([("1/a.ts", "plain words\nof a text"), ("2/a.ts", None), ("3/a.ts", ""), ("4/a.ts", "x\r\nrouter.get('/a', h)\n jwt.verify(t)")], "path string, content string")
    got = matching.line_hits(files, patterns("auth-bypass"))
    assert [(r.path, r.line, r.pattern_id) for r in got.orderBy("path", "line").collect()] == [("4/a.ts", 2, "express_route_def"), ("4/a.ts", 3, "jwt_verify")]
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    spark.conf.set("spark.sql.maxPlanStringLength", 50_000_000)
    plan = got.select("path", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("lower(content"), plan.count("lower(_line"), plan.count("RLIKE(_line")) == (1, 1, len(patterns("auth-bypass")))
