"""Scalar functions over text, paths, money and time, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = r"\r?\n"

# They decide results.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
LANGUAGES = {"ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "py": "py", "go": "go", "rb": "rb", "java": "java", "kt": "kt"}
Z95 = 1.959963984540054
# End of fixed values.


def lines_of(content: Column) -> Column:
    """Lines of a text, split at LF or CRLF; an empty text is one empty line."""
    return F.split(content, NEWLINE, -1)


def newlines_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(content: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    return (newlines_in(F.substring(content, F.lit(1), position - 1)) + 1).cast("int")


def line_text(content: Column, line: Column, limit: int = 200) -> Column:
    """The trimmed text of a 1-based line, at most `limit` characters."""
    return F.substring(F.trim(F.coalesce(F.get(lines_of(content), line - 1), F.lit(""))), 1, limit)


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))


def ellipsis(text: Column, limit: int) -> Column:
    """`text`, cut to `limit` characters with a final ellipsis if longer."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def table_cell(text: Column) -> Column:
    """Escaped for a markdown table cell."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")


def fence(code: Column) -> Column:
    """A backtick fence longer than any run inside `code`, three at least."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def snippet(content: Column, line: Column, limit: int = 10) -> Column:
    """From `line` on: leading blank lines skipped, at most `limit` lines."""
    rest = F.slice(lines_of(content), line, F.size(lines_of(content)))
    body = F.regexp_replace(F.array_join(rest, "\n"), r"\A(?:[ \t]*\n)+", "")
    return F.array_join(F.slice(F.split(body, "\n", -1), 1, limit), "\n")


def context(content: Column, line: Column, before: int = 8, after: int = 16) -> Column:
    """The lines around `line`."""
    start = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(lines_of(content), start, line + after - start + 1), "\n")


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), severity)


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """Bound of the Wilson 95 % interval of k successes in n, clamped to [0, 1]; (0, 0) for n = 0."""
    z2 = Z95 * Z95
    p, centre = k / n, k / n + F.lit(z2) / (2 * n)
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    bound = (centre + (half if upper else -half)) / (1 + F.lit(z2) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bound)))


def budget_ratio_warning(spent: Column, cap: Column) -> Column:
    """spent / cap where it is from 0.8 to under 1, else null; no cap, no warning."""
    ratio = spent / cap
    return F.when((cap > 0) & (ratio >= 0.8) & (ratio < 1), ratio)


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 30_000) -> Column:
    """Wait before a retry, doubled each time up to a cap."""
    steps = F.least(F.greatest(attempt, F.lit(0)), F.lit(40))
    return F.least(F.lit(cap).cast("double"), F.lit(base) * F.pow(F.lit(2.0), steps)).cast("long")


def clip_utf8(text: str, limit: int, marker: str, notice: str, spare: int = 64, least: int = 4096) -> str:
    """`text` within `limit` UTF-8 bytes: what precedes its last `marker` is cut, `notice` and the marker's part follow; a missing marker is added."""
    if len(text.encode()) <= limit:
        return text
    at = text.rfind(marker)
    head, tail = (text[:at], text[at:]) if at >= 0 else (text, f"\n\n{marker}\n")
    room = max(least, limit - len(notice.encode()) - len(tail.encode()) - spare)
    return head.rstrip().encode()[:room].decode("utf-8", "ignore").rstrip() + notice + tail
