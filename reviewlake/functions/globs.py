"""Path globs as Java regular expressions.

Supported: ``*`` and ``?`` inside one path segment, ``**`` as a whole segment
for any number of segments, ``[class]`` with ``!`` or ``^`` negation, nested
``{a,b}`` alternatives and backslash escapes. A pattern that is not well
formed has no regex and so matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


def _quote(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """Translate the class whose ``[`` is at ``at``; give the regex and its end.

    A range that runs backwards holds no character.
    """
    pos = at + 1
    negated = pos < len(glob) and glob[pos] in "!^"
    pos += negated
    body: list[str] = []
    members = 0
    while pos < len(glob) and glob[pos] != "]":
        bounds = []
        for _ in range(2):
            if glob[pos] == "\\":
                pos += 1
            if pos >= len(glob) or (not bounds and glob[pos] == "-"):
                return None
            bounds.append(glob[pos])
            pos += 1
            if len(bounds) == 2 or pos + 1 >= len(glob) or glob[pos] != "-":
                break
            if glob[pos + 1] == "]":
                return None
            pos += 1
        members += 1
        if bounds[0] <= bounds[-1]:
            body.append("-".join(map(_quote, bounds)))
    if pos >= len(glob) or not members:
        return None
    if not body:
        return "[^/]" if negated else "(?!)", pos + 1
    return f"(?!/)[{'^' if negated else ''}{''.join(body)}]", pos + 1


def glob_to_regex(glob: str) -> str | None:
    out: list[str] = []
    depth = 0
    pos = 0
    while pos < len(glob):
        char = glob[pos]
        starts_segment = pos == 0 or glob[pos - 1] in "/{,"
        if glob.startswith("**", pos) and starts_segment:
            end = pos + 2
            if end == len(glob) or (depth and glob[end] in ",}"):
                if out and out[-1] == "/":
                    out[-1] = "(?:/.*)?"
                else:
                    out.append(".*")
                pos = end
                continue
            if glob[end] == "/":
                out.append("(?:.*/)?")
                pos = end + 1
                continue
        if char == "*":
            while pos < len(glob) and glob[pos] == "*":
                pos += 1
            out.append("[^/]*")
            continue
        if char == "?":
            out.append("[^/]")
        elif char == "[":
            translated = _class(glob, pos)
            if translated is None:
                return None
            out.append(translated[0])
            pos = translated[1]
            continue
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        elif char == "\\":
            pos += 1
            if pos == len(glob):
                return None
            out.append(_quote(glob[pos]))
        else:
            out.append(_quote(char))
        pos += 1
    if depth:
        return None
    return "".join(out)


def any_glob_regex(globs: Iterable[str] | None) -> str | None:
    """One anchored regex matching what any well-formed glob matches."""
    parts = [glob_to_regex(g) for g in (globs if globs is not None else ()) if g is not None]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return "(?s)^(?:" + "|".join(parts) + ")\\z"


@F.pandas_udf(T.StringType())
def _any_glob_regex_udf(lists: pd.Series) -> pd.Series:
    return lists.map(any_glob_regex)


def exclusion_regex(globs: Column) -> Column:
    """Array of globs to one regex; meant for configuration rows, not for paths."""
    return _any_glob_regex_udf(globs)
