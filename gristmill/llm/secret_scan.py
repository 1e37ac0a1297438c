"""Secret scan by one combined deterministic automaton.

All rules are compiled together (subset construction, minimisation, transition arrays). Each text
is read once, byte by byte from its end; the state after a byte tells which rules have a match
that starts there. From the leftmost start at or after the last match's end, the rule's own
automaton reads on to the longest end; so matches are leftmost, longest and non-overlapping per
kind, and bytes outside matches are read once.

Base kinds (assign, access, hex) are reported even where other kinds overlap them; further kinds
add spans: private-key headers, web tokens, and service keys with a fixed prefix.

Edge cases: a null text counts as empty and gives a row without spans; offsets are code points;
texts of any length are read whole; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.automaton import Rule, alt, cls, lit, match_automaton, rep, search_automaton, seq
from gristmill.llm.scan import code_points, joined, sha256, slices
from gristmill.runtime import ship

ship(__name__)
ship("gristmill.llm.scan")
ship("gristmill.llm.automaton")

QUOTE = rep(cls("\"'"), 0, 1)
SPACES = rep(cls(" "))
VALUE = cls("A-Za-z0-9+/_.=-")
NAME = alt(lit("password", True), lit("passwd", True), lit("secret", True), lit("token", True), seq(lit("api", True), rep(lit("_"), 0, 1), lit("key", True)))
ALNUM = cls("A-Za-z0-9")
URLSAFE = cls("A-Za-z0-9_-")

#: Base kinds first, in their order. Only hex counts in the automaton (else every digit would
#: mark a start); other matches of any length use up their bytes and are dropped if too short,
#: which also keeps counters of nested byte classes from multiplying states.
RULES = [
    Rule("assign", seq(NAME, QUOTE, SPACES, cls(":="), SPACES, QUOTE, rep(VALUE, 1))),
    Rule("access", seq(lit("AKIA"), rep(cls("A-Z0-9"), 1))),
    Rule("hex", rep(cls("0-9a-f"), 24)),
    Rule("pem", seq(lit("-----BEGIN "), rep(cls("A-Z0-9 ")), lit("PRIVATE KEY-----"))),
    Rule("jwt", seq(lit("eyJ"), rep(URLSAFE, 1), lit(".eyJ"), rep(URLSAFE, 1), lit("."), rep(URLSAFE, 1))),
    Rule("vcs", seq(lit("gh"), cls("pousr"), lit("_"), rep(ALNUM, 1))),
    Rule("chat", seq(lit("xox"), cls("abprs"), lit("-"), rep(cls("A-Za-z0-9-"), 1))),
    Rule("pay", seq(alt(lit("sk"), lit("rk")), lit("_live_"), rep(ALNUM, 1))),
    Rule("cloud", seq(lit("AIza"), rep(URLSAFE, 1))),
]
#: Least length of a whole match.
LEAST = {"access": 20, "jwt": 40, "vcs": 34, "chat": 15, "pay": 24, "cloud": 39}
BASE = ("assign", "access", "hex")
KINDS = [r.kind for r in RULES]
LEAST_VALUE = 6
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        dfa = search_automaton(rules)
        self.marks, self.first_mark = dfa.marks, next((i for i, m in enumerate(dfa.marks) if m), len(dfa.marks))
        self.rows, self.start = dfa.rows, dfa.start
        self.ends = [match_automaton(r) for r in rules]
        # from a sink no byte leads on and nothing is accepted
        self.sinks = [{s for s, row in enumerate(d.rows) if not d.marks[s] and all(t == s for t in row)} for d in self.ends]

    def starts(self, data: bytes) -> list[list[int]]:
        """[first, last, rules]: runs of offsets at which the same rules have a match, last run first. The one byte pass.

        A long run of hex digits starts a match at nearly every byte; it is held as one run.
        """
        rows, least, found = self.rows, self.first_mark, []
        row, at, run = rows[self.start], len(data), [-1, -1, 0]
        for b in reversed(data):
            at -= 1
            s = row[b]
            row = rows[s]
            if s >= least:
                mark = self.marks[s]
                if run[0] == at + 1 and run[2] == mark:
                    run[0] = at
                else:
                    run = [at, at, mark]
                    found.append(run)
        return found

    def longest(self, rule: int, data: bytes, start: int) -> int:
        """End of the longest match of `rule` at `start`."""
        dfa, sinks, s, end = self.ends[rule], self.sinks[rule], self.ends[rule].start, start
        for at in range(start, len(data)):
            s = dfa.rows[s][data[at]]
            if s in sinks:
                break
            if dfa.marks[s]:
                end = at + 1
        return end

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes; failing matches use up their bytes and are dropped."""
        found = self.starts(data)
        if not found:
            return []
        free, out = [0] * len(self.rules), []
        for first, last, mark in reversed(found):
            for i, rule in enumerate(self.rules):
                at = max(first, free[i])
                while mark >> i & 1 and at <= last:
                    end = free[i] = self.longest(i, data, at)
                    length = self.value_length(data[at:end]) if rule.kind == "assign" else end - at
                    if length >= (LEAST_VALUE if rule.kind == "assign" else LEAST.get(rule.kind, 0)):
                        out.append((rule.kind, at, end))
                    at = max(end, at + 1)
        return out

    @staticmethod
    def value_length(match: bytes) -> int:
        """Length of the value in an assignment: what follows the first : or = and its blanks and quote."""
        cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        value = match[cut + 1 :].lstrip(b" ")
        return len(value) - value.startswith((b'"', b"'"))


def _digest(doc_id, data: bytes, spans: list[tuple[str, int, int]]) -> tuple:
    points = code_points(data, [x for s in spans for x in s[1:]]) if not data.isascii() else None
    spans = [(k, points[s], points[e]) if points else (k, s, e) for k, s, e in spans]
    base = [s for s in spans if s[0] in BASE]
    count = [sum(s[0] == k for s in base) for k in BASE]
    return (doc_id, *count, sha256(joined(base, KINDS)), joined(spans, KINDS))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every whole text."""

    def run(batches):
        scanner = Scanner()
        for batch in slices(batches):
            rows = [_digest(i, data or b"", scanner.spans(data or b"")) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
