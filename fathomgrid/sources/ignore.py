"""Ignore patterns in the syntax of ``.gitignore`` files."""

from __future__ import annotations

import re
from dataclasses import dataclass


def pattern_regex(body: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` stay within a segment, ``**`` crosses them."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1 + (body[i + 1 : i + 2] == "*")
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    base: str
    regex: re.Pattern
    negated: bool
    folders_only: bool


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file that stands in folder ``base``."""
    out = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", raw)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        folders = line.endswith("/")
        body = line.rstrip("/") if folders else line
        anchored = "/" in body
        body = body.removeprefix("/")
        if body:
            out.append(Rule(base, re.compile(("" if anchored else "(?:.*/)?") + pattern_regex(body) + r"\Z", re.S), negated, folders))
    return out


def ignored(path: str, folder: bool, stack: list[Rule]) -> bool:
    """Whether the last rule that matches says so; deeper files' rules come last."""
    for r in reversed(stack):
        if folder or not r.folders_only:
            inner = path[len(r.base) + 1 :] if r.base and path.startswith(r.base + "/") else path if not r.base else None
            if inner is not None and r.regex.match(inner):
                return not r.negated
    return False
