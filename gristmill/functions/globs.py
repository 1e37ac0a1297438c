"""Globs compiled on the driver to regular expressions that Java and Python share."""

from __future__ import annotations

import re


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def glob_regex(glob: str) -> str:
    """A full-path match with dot files: * and ? stay in a segment, ** as a segment spans any number, {a,b} and [..]."""

    def brace(text: str) -> list[str]:
        m = re.search(r"\{([^{}]*,[^{}]*)\}", text)
        return [x for part in m[1].split(",") for x in brace(text[: m.start()] + part + text[m.end() :])] if m else [text]

    def segment(text: str) -> str:
        out = ""
        for m in re.finditer(r"\*+|\?|\[(!|\^)?([^\]]+)\]|[^*?\[]+|\[", text):
            if m[0].startswith("*"):
                out += "[^/]*"
            elif m[0] == "?":
                out += "[^/]"
            elif m[2]:
                out += f"[{'^' if m[1] else ''}{m[2]}]".replace("\\", "\\\\")
            else:
                out += _quoted(m[0])
        return out

    def whole(text: str) -> str:
        parts = text.split("/")
        out = ""
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            if p == "**":
                out += ".*" if last else "(?:[^/]+/)*"
            else:
                out += segment(p) + ("" if last else "/")
        return out

    return r"\A(?:" + "|".join(whole(x) for x in brace(glob)) + r")\z"


def ignore_regexes(text: str) -> tuple[list[str], list[str]]:
    """(regexes over relative paths, negations not applied) of an ignore file.

    Blank lines and comments are skipped; a leading or inner slash anchors at the root; a trailing
    slash only fits folders, that is, whatever lies below them.
    """
    out, negated = [], []
    for raw in re.split(r"\r?\n", text):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("!"):
            negated.append(line)
            continue
        folder, body = line.endswith("/"), line.strip("/")
        anchored = line.startswith("/") or "/" in body
        inner = glob_regex(body).removeprefix(r"\A(?:").removesuffix(r")\z")
        out.append(("\\A" if anchored else r"(?:\A|/)") + f"(?:{inner})" + ("/" if folder else r"(?:/|\z)"))
    return out, negated
