"""Grams of whole Arrow batches in numpy: the ones `patterns.grams` gives, without a row for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siftlake.functions.patterns import GRAM

# Bits of a code point; three of them fit a long.
_BITS = 21
# Longer texts are taken in pieces of this size, which overlap so that no gram is cut.
PIECE = 1 << 20
# A task lists the rows of its grams as soon as it holds so many pairs of gram and row (some 100 MB).
PAIRS = 4 << 20


def codes(text: str) -> np.ndarray:
    """The gram at each place of a text as a number, A-Z folded."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points[(points >= ord("A")) & (points <= ord("Z"))] += ord("a") - ord("A")
    out = np.zeros(max(len(points) - GRAM + 1, 0), np.int64)
    for k in range(GRAM):
        out = (out << _BITS) | points[k : k + len(out)]
    return out


def spelled(code: int) -> str:
    """The gram of a number."""
    return "".join(chr(code >> _BITS * k & (1 << _BITS) - 1) for k in reversed(range(GRAM)))


def distinct(text: str, piece: int = PIECE) -> np.ndarray:
    """All different grams of a text, in order."""
    parts = [np.unique(codes(text[at : at + piece + GRAM - 1])) for at in range(0, max(len(text) - GRAM + 1, 1), piece)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _lists(numbers: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    grams = np.concatenate(found)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], np.repeat(np.array(numbers, np.int32), [len(f) for f in found])[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    ends = pa.array(np.append(first, len(grams)), pa.int32())
    names = pa.array([spelled(g) for g in grams[first].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(ends, pa.array(owner, pa.int32()))], ["gram", "row_nos"])


def listed(batches: Iterator[pa.RecordBatch], pairs: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """(gram, row_nos) of batches of (row_no, value): the numbers of the rows whose text has the gram, in lists of
    bounded length. Null texts have none."""
    numbers, found, held = [], [], 0
    for batch in batches:
        for number, text in zip(batch.column("row_no").to_pylist(), batch.column("value").to_pylist()):
            if text is None:
                continue
            numbers.append(number)
            found.append(distinct(text))
            held += len(found[-1])
            if held >= pairs:
                yield _lists(numbers, found)
                numbers, found, held = [], [], 0
    if found:
        yield _lists(numbers, found)
