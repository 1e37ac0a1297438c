"""Literals that every match of a pattern holds: a search for them spares most texts the pattern itself."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter literals are in most texts, and more alternatives cost as much as the pattern.
SHORTEST, MOST = 3, 12


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two sets of alternatives the one whose shortest literal is longer."""
    if a is None or b is None:
        return a or b
    return a if (min(map(len, a)), -len(a)) >= (min(map(len, b)), -len(b)) else b


def _exact(op, arg) -> tuple | None:
    """All that one item of a pattern can match, if these are few fixed strings."""
    if op is C.AT:  # takes no room
        return ("",)
    if op is C.LITERAL:
        return (chr(arg),)
    if op is C.IN and len(arg) <= 2 and all(kind is C.LITERAL for kind, _ in arg):
        return tuple(chr(x) for _, x in arg)
    if op is C.SUBPATTERN and arg[0] is None and not arg[1] & re.IGNORECASE:
        return _product(arg[3])
    if op is C.BRANCH:
        each = [_product(x) for x in arg[1]]
        return tuple(dict.fromkeys(x for some in each for x in some)) if None not in each else None
    return None


def _product(items) -> tuple | None:
    """All that a sequence of items can match, if these are few fixed strings."""
    out = ("",)
    for op, arg in items:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = tuple(a + b for a in out for b in one)
    return out


def _least(found) -> tuple:
    """Without those that hold another one."""
    found = tuple(dict.fromkeys(found))
    return tuple(x for x in found if not any(y != x and y in x for y in found))


def _of(items) -> tuple | None:
    best, run = None, ("",)
    kept = lambda run: run if all(run) else None
    for op, arg in items:
        one = _exact(op, arg)
        if one == ("",):
            continue
        if one is not None and len(run) == 1:  # what lies side by side is one literal: a dot and the names behind it
            run = tuple(run[0] + x for x in one)
            continue
        best, run = _better(best, kept(run)), one or ("",)
        if one is not None:
            continue
        if op is C.SUBPATTERN and not arg[1] & re.IGNORECASE:
            best = _better(best, _of(arg[3]))
        elif op is C.BRANCH:
            each = [_of(x) for x in arg[1]]
            if None not in each:
                best = _better(best, _least(x for alternatives in each for x in alternatives))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            best = _better(best, _of(arg[2]))
    return _better(best, kept(run))


@cache
def required(regex: str) -> tuple[tuple[str, ...], bool] | None:
    """Literals of which each match of `regex` holds at least one, and whether in lower case, as letters match in either case; None if nothing useful follows."""
    try:
        tree = _parser.parse(regex.replace(r"\z", r"\Z"))
    except re.error:
        return None
    fold = bool(tree.state.flags & re.IGNORECASE)
    found = _of(tree)
    if not found or len(found) > MOST or min(map(len, found)) < SHORTEST or fold and not all(x.isascii() for x in found):
        return None
    return tuple(dict.fromkeys(x.lower() for x in found)) if fold else found, fold


def may_match(text: Column, lower: Column, regex: str) -> Column:
    """Whether `text`, with `lower` its lower-case form, holds what a match of `regex` needs."""
    known = required(regex)
    if known is None:
        return F.lit(True)
    found, fold = known
    text = lower if fold else text
    out = text.contains(found[0])
    for x in found[1:]:
        out = out | text.contains(x)
    return out
