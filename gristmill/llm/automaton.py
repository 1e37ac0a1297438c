"""Byte automata: rule syntax -> position automaton -> subset construction -> minimisation.

A rule is written with the few operators below. Rules are reversed before they are compiled,
so one pass from the last byte to the first marks, for every rule at once, the bytes at which
a match starts; the end of a match is then found by the rule's own forward automaton.
"""

from __future__ import annotations

from dataclasses import dataclass

ANY = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """kind: name of its spans; pattern: a tree of `lit`, `cls`, `seq`, `alt`, `rep`."""

    kind: str
    pattern: tuple


def cls(chars: str) -> tuple:
    """One byte out of `chars`; a-z style ranges."""
    got, i = set(), 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            got.update(range(ord(chars[i]), ord(chars[i + 2]) + 1))
            i += 3
        else:
            got.add(ord(chars[i]))
            i += 1
    return ("cls", frozenset(got))


def seq(*parts) -> tuple:
    return ("seq", parts)


def alt(*parts) -> tuple:
    return ("alt", parts)


def lit(text: str, fold: bool = False) -> tuple:
    """The bytes of `text`; fold: letters in either case."""
    return seq(*(("cls", frozenset({ord(c.lower()), ord(c.upper())} if fold else {ord(c)})) for c in text))


def rep(part, least: int = 0, most: int | None = None) -> tuple:
    """`part` at least `least` times, at most `most` (None: any number)."""
    return ("rep", part, least, most)


def reverse(p: tuple) -> tuple:
    if p[0] == "seq":
        return ("seq", tuple(reverse(x) for x in reversed(p[1])))
    if p[0] == "alt":
        return ("alt", tuple(reverse(x) for x in p[1]))
    if p[0] == "rep":
        return ("rep", reverse(p[1]), *p[2:])
    return p


class Nfa:
    """States with byte-class edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, p: tuple, start: int) -> int:
        """Builds `p` from `start`; returns its end state."""
        if p[0] == "cls":
            end = self.state()
            self.edges[start].append((p[1], end))
            return end
        if p[0] == "seq":
            for x in p[1]:
                start = self.add(x, start)
            return start
        if p[0] == "alt":
            end = self.state()
            for x in p[1]:
                self.empty[self.add(x, start)].append(end)
            return end
        _, part, least, most = p
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """Transition arrays: rows[state][byte] is the next state; marks[state] the bit set of rules that accept."""

    rows: list[list[int]]
    marks: list[int]
    start: int


def _byte_classes(nfa: Nfa) -> list[list[int]]:
    """Bytes that no edge tells apart."""
    sets = list({c for out in nfa.edges for c, _ in out})
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    return list(groups.values())


def determinise(nfa: Nfa, start: set[int], accept: dict[int, int]) -> Dfa:
    """Subset construction; `accept` maps an end state to its rule's bit."""
    groups = _byte_classes(nfa)
    first = nfa.closure(start)
    number, todo, rows, marks = {first: 0}, [first], [], []
    while todo:
        here = todo.pop(0)
        mark = 0
        for s in here:
            mark |= accept.get(s, 0)
        row = [0] * 256
        for group in groups:
            b = group[0]
            to = nfa.closure({t for s in here for c, t in nfa.edges[s] if b in c})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            for x in group:
                row[x] = number[to]
        rows.append(row)
        marks.append(mark)
    return Dfa(rows, marks, 0)


def minimise(dfa: Dfa) -> Dfa:
    """Merges states that no input tells apart, by refining the partition of equal marks.

    The result is numbered so that states without marks come first.
    """
    block = list(dfa.marks)
    names = {m: i for i, m in enumerate(dict.fromkeys(block))}
    block = [names[m] for m in block]
    columns = list({tuple(r[b] for r in dfa.rows): b for b in range(256)}.values())
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((block[s], *(block[dfa.rows[s][b]] for b in columns)), len(keys)) for s in range(len(block))]
        if len(keys) == len(set(block)):
            break
        block = new
    rep_of = {}
    for s, k in enumerate(block):
        rep_of.setdefault(k, s)
    order = sorted(rep_of, key=lambda k: (dfa.marks[rep_of[k]] != 0, rep_of[k]))
    place = {k: i for i, k in enumerate(order)}
    rows = [[place[block[t]] for t in dfa.rows[rep_of[k]]] for k in order]
    return Dfa(rows, [dfa.marks[rep_of[k]] for k in order], place[block[dfa.start]])


def search_automaton(rules: list[Rule]) -> Dfa:
    """Of all rules read backwards, from any byte: marks where matches start."""
    nfa, accept = Nfa(), {}
    root = nfa.state()
    nfa.edges[root].append((ANY, root))
    for i, rule in enumerate(rules):
        end = nfa.add(reverse(rule.pattern), root_of(nfa, root))
        accept[end] = accept.get(end, 0) | 1 << i
    return minimise(determinise(nfa, {root}, accept))


def root_of(nfa: Nfa, root: int) -> int:
    """A fresh state below `root`, so that rules don't share first edges."""
    s = nfa.state()
    nfa.empty[root].append(s)
    return s


def match_automaton(rule: Rule) -> Dfa:
    """Of one rule read forwards, anchored; its first state without way on is the sink."""
    nfa = Nfa()
    start = nfa.state()
    end = nfa.add(rule.pattern, start)
    return minimise(determinise(nfa, {start}, {end: 1}))
