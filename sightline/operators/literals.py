"""What a pattern's text tells of its matches: literals that each match holds, and how a search's time can grow.

Literals are folded (lower case, ASCII). A text is folded alike before it is searched for them, so a text without any of a
pattern's literals has no match of it, whatever the pattern's flags.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters outside ASCII that match ASCII letters where case is ignored.
ODD_CASE = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}
_ODD = str.maketrans(ODD_CASE)
_LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e"
_REPEATS = (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT)
#: Growth of a pattern whose search can take time beyond any power of the text's length.
ENDLESS = 99
#: A repeat that may go on so long counts as one without an end.
LONG = 50


def fold(text: str) -> str:
    """Lower case; as long as the text."""
    return (text if text.isascii() else text.translate(_ODD)).lower()


def folded(text: Column) -> Column:
    """The same for a column."""
    plain = F.length(text) == F.octet_length(text)
    return F.lower(F.when(plain, text).otherwise(F.translate(text, "".join(ODD_CASE), "".join(ODD_CASE.values()))))


def _parsed(pattern: str):
    try:
        return _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None  # another engine's syntax


def _better(one: tuple[str, ...] | None, other: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The choice of literals that fewer texts hold, as far as lengths tell."""
    return max((x for x in (one, other) if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _held(seq) -> tuple[str, ...] | None:
    best, run = None, ""
    for op, arg in seq:
        found = None
        if op is c.LITERAL and arg < 128 and chr(arg) not in _LINE_ENDS:
            run += chr(arg).lower()
            continue
        if op in (c.AT, c.ASSERT, c.ASSERT_NOT):  # they take no characters, so the run goes on
            continue
        if op is c.SUBPATTERN:
            found = _held(arg[-1])
        elif op is c.ATOMIC_GROUP:
            found = _held(arg)
        elif op in _REPEATS and arg[0] > 0:
            found = _held(arg[2])
        elif op is c.BRANCH:
            each = [_held(b) for b in arg[1]]
            found = tuple(sorted({x for e in each for x in e})) if all(each) else None
        best, run = _better(_better(best, (run,) if run else None), found), ""
    return _better(best, (run,) if run else None)


def held_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals of which each match of the pattern holds one at least; none if the pattern tells no such."""
    tree = _parsed(pattern)
    return _held(tree) if tree is not None else None


def _growth(seq, inside: bool) -> int:
    n = 0
    for op, arg in seq:
        if op in _REPEATS:
            endless = arg[1] is c.MAXREPEAT or arg[1] > LONG
            if inside and arg[0] != arg[1]:
                return ENDLESS
            n += endless + _growth(arg[2], inside or endless)
        elif op is c.BRANCH:
            if inside:
                return ENDLESS
            n += max(_growth(b, inside) for b in arg[1])
        elif op is c.SUBPATTERN:
            n += _growth(arg[-1], inside)
        elif op is c.ATOMIC_GROUP:
            n += _growth(arg, inside)
        elif op in (c.ASSERT, c.ASSERT_NOT):
            n += _growth(arg[1], inside)
        elif op in (c.GROUPREF, c.GROUPREF_EXISTS):
            return ENDLESS
    return min(n, ENDLESS)


def growth(pattern: str) -> int:
    """The power of a line's length that bounds the time of a search: 1, and 1 more for each repeat without an end.

    ``ENDLESS`` where repeats or choices stand inside such a repeat, where a group is referred to, and for syntax of other engines.
    """
    tree = _parsed(pattern)
    if tree is None:
        return ENDLESS
    n = _growth(tree, False)
    return ENDLESS if n >= ENDLESS else n + 1


#: Bytes of a literal that stand for it: the largest of these that it has.
WINDOWS = (3, 4, 6, 8, 12, 16, 24, 32)
#: Keys of windows: a byte's place counts by powers of this, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def windows(literal: str) -> list[dict]:
    """Windows of which each stands for the literal (key, first three bytes as ``run``, size); none for literals of under three characters.

    They overlap by half or more, so a short part in which literals differ is inside one of them, unless it is cut by both ends.
    """
    data = literal.encode()
    size = max((w for w in WINDOWS if w <= len(data)), default=0)
    last, out = len(data) - size, []
    if size:
        for at in sorted({*range(0, last, 1 if last <= size else size // 2), last}):
            key = 0
            for x in data[at : at + size]:
                key = (key * BASE + x + 1) & 0xFFFFFFFFFFFFFFFF
            out.append({"key": key >> 1, "run": int.from_bytes(data[at : at + 3], "big"), "size": size})
    return out
