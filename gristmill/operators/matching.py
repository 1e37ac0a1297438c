"""Multi-pattern matching: each content is read once, with all patterns of a catalogue in one projection.

A search for the literals that a pattern's matches hold (`functions.literals`) comes before the pattern
itself, so that most contents pay for the patterns they may match only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.catalog import REDACTED, Pattern
from gristmill.functions.literals import may_match
from gristmill.functions.text import line_at, line_text, lines_of
from gristmill.operators.files import allowed
from gristmill.runtime import fresh

HIT = "array<struct<pattern_id:string,ord:int,tier:string,pos:int,line:int,text:string>>"


def first_position(content: Column, pattern: Pattern) -> Column:
    """1-based position of the first match, null without one. The pattern is searched for once: its place is bound before it is used."""
    lead = lambda at: F.substring(content, at, F.lit(1)).isin("\n", "\r").cast("int") if pattern.lead else F.lit(0)
    found = F.array(F.regexp_instr(content, F.lit(pattern.regex)).cast("int"))
    return F.get(F.transform(found, lambda at: F.when(at > 0, at + lead(at))), F.lit(0))


def earliest_hit(files: DataFrame, patterns: list[Pattern], into: str = "hit") -> DataFrame:
    """`files` (path, content) with the struct `into` of the earliest match of all patterns, ties by order.

    Patterns that a path does not admit are left out, so others can win. Null without a match.
    """
    low = fresh(files.columns, "low")
    files = files.withColumn(low, F.lower("content"))
    found = [F.when(allowed(p, F.col("path")) & may_match(F.col("content"), F.col(low), p.regex), F.struct(first_position(F.col("content"), p).alias("pos"), F.lit(p.ord).alias("ord"), F.lit(p.id).alias("pattern_id"), F.lit(p.tier).alias("tier"))) for p in patterns]
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull() & x["pos"].isNotNull()))
    out = files.withColumn("_best", best)
    line = line_at(F.col("content"), F.col("_best.pos"))
    hit = F.struct("_best.pattern_id", "_best.ord", "_best.tier", "_best.pos", line.alias("line"), line_text(F.col("content"), line).alias("text"))
    return out.withColumn(into, F.when(F.col("_best").isNotNull(), hit)).drop("_best", low)


def unredacted_hit(files: DataFrame, patterns: list[Pattern], redacted: str = REDACTED) -> DataFrame:
    """Earliest match per file over hits whose text is not a placeholder: (path, hit columns)."""
    hits = all_hits(files, patterns).where(~F.col("match").rlike(redacted))
    best = F.min(F.struct("pos", "ord", "pattern_id", "line", "text")).alias("b")
    return hits.groupBy("path").agg(best).select("path", "b.pattern_id", "b.ord", "b.pos", "b.line", "b.text")


def _quoted(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _breaks(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')))"


def _matches(content: str, pattern: Pattern) -> str:
    """SQL for (role, pattern_id, ord, pos, line, match) of every non-overlapping match in the column `content`.

    Running sums over the matches and the texts before them give the offsets. SQL text, as a
    catalogue of column objects takes the driver longer to build than the scan of a small corpus.
    """
    rx = _quoted(pattern.regex)
    lead = "int(startswith(x.m, '\\n') OR startswith(x.m, '\\r'))" if pattern.lead else "0"
    broken = "int(startswith(x.m, '\\n'))" if pattern.lead else "0"
    pieces = f"zip_with(found, slice(split({content}, {rx}, -1), 1, size(found)), (m, gap) -> named_struct('m', m, 'gap', gap))"
    one = f"named_struct('role', '{pattern.role}', 'pattern_id', '{pattern.id}', 'ord', {pattern.ord}, 'pos', acc.chars + length(x.gap) + 1 + {lead}, 'line', acc.breaks + {_breaks('x.gap')} + {broken} + 1, 'match', x.m)"
    step = f"named_struct('chars', acc.chars + length(x.gap) + length(x.m), 'breaks', acc.breaks + {_breaks('x.gap')} + {_breaks('x.m')}, 'out', concat(acc.out, array({one})))"
    zero = "named_struct('chars', 0, 'breaks', 0, 'out', cast(array() AS array<struct<role:string,pattern_id:string,ord:int,pos:int,line:int,match:string>>))"
    matched = f"aggregate({pieces}, {zero}, (acc, x) -> {step}, acc -> acc.out)"
    return f"get(transform(array(regexp_extract_all({content}, {rx}, 0)), found -> CASE WHEN size(found) > 0 THEN {matched} END), 0)"


def all_hits(files: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """One row per match of each pattern: path, role, pattern_id, ord, pos, line, match, text (its line, 200 characters).

    A content is cut into lines once, and its hits take their lines' texts before they become rows.
    """

    def tagged(p: Pattern) -> Column:
        return F.when(allowed(p, F.col("path")) & may_match(F.col("content"), F.col("_low"), p.regex), F.expr(_matches("content", p)))

    files = files.select("path", "content", F.lower("content").alias("_low"))
    hits = F.flatten(F.filter(F.array(*map(tagged, patterns)), lambda x: x.isNotNull()))
    texts = lambda lines: F.transform(hits, lambda h: F.struct(h.alias("h"), F.substring(F.trim(F.coalesce(F.get(lines, h["line"] - 1), F.lit(""))), 1, 200).alias("text")))
    rows = F.flatten(F.transform(F.array(lines_of(F.col("content"))), texts))
    return files.select("path", F.explode(rows).alias("r")).select("path", "r.h.*", "r.text")


def line_hits(files: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Per line the first pattern, in order, that matches it alone: path, line, pattern_id, ord, text.

    What a line must hold, its content holds: patterns are chosen by whole contents first, and a content without any is not cut into lines.
    Choice and hit are exploded, not filtered: a filter is pushed below their projection and computes them again, with lower-case forms for each pattern.
    """
    files = files.select("path", "content", F.lower("content").alias("_low"))
    chosen = F.array(*(allowed(p, F.col("path")) & may_match(F.col("content"), F.col("_low"), p.regex) for p in patterns))
    files = files.select("path", "content", chosen.alias("_chosen"))
    lines = files.select("path", "_chosen", F.posexplode(F.when(F.array_contains("_chosen", F.lit(True)), lines_of(F.col("content")))).alias("_i", "_line"))
    lines = lines.withColumn("_low", F.lower("_line"))
    first = F.coalesce(*[F.when(F.get("_chosen", F.lit(i)) & may_match(F.col("_line"), F.col("_low"), p.regex) & F.col("_line").rlike(p.regex), F.struct(F.lit(p.id).alias("pattern_id"), F.lit(p.ord).alias("ord"))) for i, p in enumerate(patterns)])
    hit = lines.select("path", "_i", "_line", F.explode(F.array(first)).alias("_hit")).where("_hit IS NOT NULL")
    return hit.select("path", (F.col("_i") + 1).alias("line"), "_hit.pattern_id", "_hit.ord", F.substring(F.trim("_line"), 1, 200).alias("text"))


def preferred_trigger(hits: DataFrame) -> DataFrame:
    """One trigger per file of `line_hits`: route definitions before others, then the first line."""
    key = F.struct((~F.col("pattern_id").endswith("_route_def") & ~F.col("pattern_id").endswith("_handler_def")).alias("other"), "line", "ord", "pattern_id")
    return hits.groupBy("path").agg(F.min(key).alias("k")).select("path", F.col("k.line").alias("line"), F.col("k.pattern_id").alias("pattern_id"))


def route_shape(path: Column, content: Column, routes: list[Pattern]) -> Column:
    """Whether a file declares a route of any shape that its path admits."""
    ok = F.lit(False)
    for p in routes:
        ok = ok | (allowed(p, path) & may_match(content, F.lower(content), p.regex) & content.rlike(p.regex))
    return ok
