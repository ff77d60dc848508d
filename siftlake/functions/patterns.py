"""What a text must contain to match a pattern: formulas of q-grams, for joins and indexes.

A formula is True (nothing is known), a gram, or ("and" | "or", parts). Every text with a match makes the formula true, so
it may choose rows as long as the pattern itself is tried on them afterwards.
"""

from __future__ import annotations

import re
import string
from itertools import product
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.text import column

GRAM = 3
# How many spellings of a stretch are followed; beyond that, what is known so far stands and a new stretch begins.
SPELLINGS = 64

# Only A-Z are folded, as these are the letters that patterns without Unicode flags fold.
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# Signs that Java and Python read differently: a pattern with one of them says nothing.
_DIFFERENT = re.compile(r"\\[\dvVhHRXNAzZGQEpPkc]|&&|\[[^\]]*\[|\(\?[a-zA-Z]*[ux]")


def folded(value: Column | str) -> Column:
    return F.translate(column(value), string.ascii_uppercase, string.ascii_lowercase)


def grams(value: Column | str) -> Column:
    """All different grams of a text in the form that formulas use: one pass, linear in the text."""
    return F.array_distinct(F.regexp_extract_all(folded(value), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _all(parts: list):
    known = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def _any(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_spellings(spellings: set[str]):
    return _any([_all([s[i : i + GRAM] for i in range(len(s) - GRAM + 1)]) for s in sorted(spellings)])


def _members(items) -> set[str] | None:
    """The characters of a small class."""
    found = set()
    for kind, value in items:
        if kind is code.LITERAL:
            found.add(chr(value))
        elif kind is code.RANGE and value[1] - value[0] < SPELLINGS:
            found.update(chr(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return {c.translate(_FOLD) for c in found}


def _node(kind, value):
    """(spellings, formula) of one element; spellings are None where they are not a small known set."""
    if kind is code.LITERAL:
        return {chr(value).translate(_FOLD)}, True
    if kind is code.IN:
        return _members(value), True
    if kind in (code.AT, code.ASSERT, code.ASSERT_NOT):
        return {""}, True
    if kind is code.SUBPATTERN:
        return _sequence(value[3])
    if kind is code.ATOMIC_GROUP:
        return _sequence(value)
    if kind is code.BRANCH:
        ways = [_sequence(way) for way in value[1]]
        if all(spelled is not None for spelled, _ in ways):
            spelled = set().union(*[s for s, _ in ways])
            if len(spelled) <= SPELLINGS:
                return spelled, True
        return None, _any([f if s is None else _of_spellings(s) for s, f in ways])
    if kind in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
        least, most, body = value
        spelled, formula = _sequence(body)
        if spelled is not None and (least, most) == (0, 1):
            return spelled | {""}, True
        if spelled is not None and least == most and least * max(map(len, spelled)) <= SPELLINGS and len(spelled) == 1:
            return {s * least for s in spelled}, True
        if not least:
            return None, True
        return None, formula if spelled is None else _of_spellings(spelled)
    return None, True


def _sequence(items):
    """Elements in a row: neighbours with known spellings are put together, so grams reach over them."""
    stretch, known, whole = {""}, [], True
    for kind, value in items:
        spelled, formula = _node(kind, value)
        if spelled is not None and len(stretch) * len(spelled) <= SPELLINGS:
            stretch = {a + b for a, b in product(stretch, spelled)}
            continue
        known += [_of_spellings(stretch), formula]
        stretch, whole = spelled if spelled is not None else {""}, False
    if whole:
        return stretch, True
    return None, _all([*known, _of_spellings(stretch)])


def formula(pattern: str):
    """The formula of a pattern; True for patterns that name no gram or are not surely read alike by both engines."""
    if _DIFFERENT.search(pattern):
        return True
    try:
        spelled, known = _sequence(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return True
    return known if spelled is None else _of_spellings(spelled)


def cover(known) -> list[str] | None:
    """Grams of which every matching text holds one, as few as the formula allows; None when it says nothing."""
    if known is True:
        return None
    if isinstance(known, str):
        return [known]
    covers = [cover(part) for part in known[1]]
    if known[0] == "or":
        return sorted(set().union(*covers))
    # Among equal numbers, grams with signs and rare letters are in fewer lines than plain ones.
    return min(covers, key=lambda c: (len(c), sum(g.count(x) for g in c for x in " etaoinsr"), c))


def leaves(known) -> list[str]:
    """All grams a formula names."""
    if known is True:
        return []
    if isinstance(known, str):
        return [known]
    return sorted({gram for part in known[1] for gram in leaves(part)})


def holds(known, found: Column) -> Column:
    """The formula over an array of the grams that were found."""
    if known is True:
        return F.lit(True)
    if isinstance(known, str):
        return F.array_contains(found, known)
    parts = [holds(part, found) for part in known[1]]
    out = parts[0]
    for part in parts[1:]:
        out = (out & part) if known[0] == "and" else (out | part)
    return out
