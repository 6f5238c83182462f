"""Counts of patterns, after a plain search for what their matches must hold.

A search for fixed bytes costs a small part of what a pattern with word edges
costs, and most texts hold few of the listed phrases.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces that are searched for at most; with more of them the pattern itself is as fast.
MOST = 12


def _pieces(parsed) -> set[str] | None:
    """Of a parsed pattern: pieces of which each match has at least one, or None."""
    found, run = [], ""

    def best(options: list[set[str] | None]) -> set[str] | None:
        known = [x for x in options if x and min(map(len, x)) > 0]
        return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    for op, value in [*parsed, (None, None)]:
        if op is K.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if op is K.SUBPATTERN:
            found.append(_pieces(value[3]))
        elif op is K.MAX_REPEAT or op is K.MIN_REPEAT:
            found.append(_pieces(value[2]) if value[0] > 0 else None)
        elif op is K.BRANCH:
            each = [_pieces(x) for x in value[1]]
            found.append(None if None in each else set().union(*each))
    return best(found)


def needed(pattern: str) -> list[str]:
    """Lower-case pieces of which every match has one at least; empty if that is unknown or they are too many."""
    try:
        found = _pieces(_parser.parse(re.sub(r"\(\?[a-z]+\)", "", pattern)))
    except re.error:  # the JVM's own syntax
        return []
    return sorted(found) if found and len(found) <= MOST else []


BEHIND, AHEAD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _at_end(parsed, k: int) -> bool:
    """Whether all matches of a parsed pattern begin (k is 0) or end (k is -1) with an ASCII word's sign."""
    if not len(parsed):
        return False
    op, value = parsed[k]
    if op is K.LITERAL:
        return chr(value) in _WORD
    if op is K.IN:
        inside = lambda o, v: chr(v) in _WORD if o is K.LITERAL else o is K.RANGE and all(chr(c) in _WORD for c in range(v[0], min(v[1], 128) + 1)) and v[1] < 128
        return all(inside(o, v) for o, v in value)
    if op is K.SUBPATTERN:
        return _at_end(value[3], k)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        return value[0] > 0 and _at_end(value[2], k)
    return op is K.BRANCH and all(_at_end(x, k) for x in value[1])


def _level(pattern: str, step: int) -> str:
    """A pattern up to the first bracket (from the end for step -1) that closes a group around it."""
    depth, signs = 0, re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern, re.S)
    kept = []
    for x in signs[::step]:
        depth += {"(": step, ")": -step}.get(x, 0)
        if depth < 0:
            break
        kept.append(x)
    return "".join(kept[::step]).removeprefix("?:" if step < 0 else "")


def half_edges(pattern: str) -> str:
    """Looks to one side at word edges that have an ASCII word's sign on the other in each match; this is
    the same edge at half the price. Edges of which that isn't known stay."""

    def sure(part: str, k: int) -> bool:
        try:
            return _at_end(_parser.parse(re.sub(r"\(\?[a-z]+\)", "", part)), k)
        except re.error:  # the JVM's own syntax
            return False

    out, parts = "", pattern.split(r"\b")
    for i, part in enumerate(parts):
        out += part
        if i < len(parts) - 1:
            before, after = r"\b".join(parts[: i + 1]), r"\b".join(parts[i + 1 :])
            out += BEHIND if sure(_level(after, 1), 0) else AHEAD if sure(_level(before, -1), -1) else r"\b"
    return out


def _any_of(low: Column, pieces: list[str]) -> Column:
    out = F.contains(low, F.lit(pieces[0]))
    for p in pieces[1:]:
        out = out | F.contains(low, F.lit(p))
    return out


def in_a_line(pattern: str) -> str:
    """Of a pattern whether ``a.*b`` occurs: the same from the line's first a on only, as no later one finds more."""
    a, found, b = pattern.removeprefix("(?i)").partition(".*")
    return f"(?im)^(?>.*?(?:{a})).*(?:{b})" if found else pattern


def times(text: Column, pattern: str, jvm: Column, low: Column | None = None) -> Column:
    """How often ``jvm``, the JVM's form of the pattern, occurs. ``low`` is the text in lower case."""
    pieces = needed(pattern)
    count = F.regexp_count(text, jvm)
    return F.when(_any_of(F.lower(text) if low is None else low, pieces), count).otherwise(0) if pieces else count


def found(text: Column, pattern: str, jvm: str, low: Column | None = None) -> Column:
    """Whether ``jvm`` occurs, as 0 or 1."""
    pieces = needed(pattern)
    hit = text.rlike(jvm).cast("int")
    return F.when(_any_of(F.lower(text) if low is None else low, pieces), hit).otherwise(0) if pieces else hit
