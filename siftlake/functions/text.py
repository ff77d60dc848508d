"""Text columns: white space, byte lengths, byte cuts and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Unicode white space set that trimming removes.
WHITE_SPACE = (
    " \t\n\v\f\r\u0085  "
    "           "
    "    　"
)


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(value: Column | str) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(column(value), F.lit(WHITE_SPACE))


def spaced(value: Column | str) -> Column:
    """Whether a text starts or ends with white space."""
    t = column(value)
    return F.left(t, F.lit(1)).isin(list(WHITE_SPACE)) | F.right(t, F.lit(1)).isin(list(WHITE_SPACE))


def blank(value: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trim_all(value), F.lit("")) == ""


def or_default(value: Column | str, default: Column | str) -> Column:
    """Trimmed text, or the default when blank."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(blank(value), fallback).otherwise(trim_all(value))


def byte_length(value: Column | str) -> Column:
    return F.octet_length(column(value))


def cut_bytes(value: Column | str, size: int | Column, mark: str = "") -> Column:
    """At most `size` bytes of the text, plus the mark when something was cut.

    A character split by the cut becomes the replacement character.
    """
    text = column(value)
    limit = F.lit(size) if isinstance(size, int) else size
    head = F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), limit).cast("string"))
    return F.when(byte_length(text) > limit, F.concat(head, F.lit(mark))).otherwise(text)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a shell glob whose `*` and `?` do not cross `/`."""
    pattern = pattern.removeprefix("**/")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("^") else body) + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def regex(pattern: str) -> str:
    """A rule pattern for Java's engine, with `\\b` and `\\s` kept to ASCII as the rules expect."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and not in_class:
            out.append(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
        elif pair == r"\s":
            out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
        elif pattern[i] == "\\":
            out.append(pair)
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i -= 1
        i += 2
    return "".join(out)
