"""Path columns: normal form, ignored directories, release scope, walk order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.text import column


def clean_path(value: Column | str) -> Column:
    """Slash form without empty and `.` parts and with `..` resolved; `.` when nothing is left."""
    raw = column(value)
    text = F.replace(raw, F.lit("\\"), F.lit("/"))
    rooted = text.startswith("/")
    parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))

    def step(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return (
            F.when(part != "..", F.concat(stack, F.array(part)))
            .when((F.size(stack) > 0) & (top != ".."), shorter)
            .when(rooted, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    folded = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit(".")))
    # Most paths are clean already; only the others pay for the fold.
    return F.when(raw.rlike(r"^$|\\|//|(^|/)\.{1,2}(/|$)|.+/$"), folded).otherwise(raw)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(column(path), "/"), -1)


def parents(path: Column | str) -> Column:
    """Directory components of a file path, outermost first."""
    parts = F.split(column(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column | str) -> Column:
    """Lower-case suffix from the last dot of the base name, '' without a dot."""
    return F.regexp_extract(F.lower(base_name(path)), r"\.[^.]*$", 0)


def walk_key(path: Column | str) -> Column:
    """Sort key of a depth-first walk: `/` sorts before every other character."""
    return F.replace(column(path), F.lit("/"), F.lit("\x01"))


def has_ignored_component(path: Column | str) -> Column:
    names = F.array(*[F.lit(n) for n in dims.IGNORED_DIRECTORIES])
    return F.arrays_overlap(F.split(column(path), "/"), names)


def in_ignored_directory(path: Column | str) -> Column:
    """A directory on the way to the file is ignored; the file's own name does not count."""
    names = F.array(*[F.lit(n) for n in dims.IGNORED_DIRECTORIES])
    return F.arrays_overlap(parents(path), names)


def in_unscanned_directory(path: Column | str) -> Column:
    """The static scan skips hidden directories, `vendor` and `node_modules`."""
    return F.exists(
        parents(path), lambda d: d.startswith(".") | d.isin("vendor", "node_modules")
    )


def _release_regex(with_suffixes: bool) -> str:
    prefixes = "|".join(re.escape(p.rstrip("/")) for p in dims.RELEASE_EXCLUDED_PREFIXES)
    exact = "|".join(re.escape(p) for p in dims.RELEASE_EXCLUDED_PATHS)
    suffixes = "|".join(re.escape(s) for s in dims.RELEASE_EXCLUDED_SUFFIXES)
    scope = f"^(?:{prefixes})(?:/|$)|^(?:{exact})$"
    return f"{scope}|(?i:{suffixes})$" if with_suffixes else scope


def release_excluded(path: Column | str, is_dir: Column | None = None) -> Column:
    """Not to be published: excluded prefixes, exact paths, and for files excluded suffixes."""
    text = clean_path(path)
    as_file = text.rlike(_release_regex(True))
    if is_dir is None:
        return as_file
    return F.when(is_dir, text.rlike(_release_regex(False))).otherwise(as_file)


def resolve_status(base: Column | str, path: Column | str) -> Column:
    """ok / outside / ignored for a requested path, relative to the project or absolute."""
    rel = relative_path(base, path)
    return (
        F.when(column(path) == "", "ok")
        .when(rel.isNull(), "outside")
        .when(has_ignored_component(rel), "ignored")
        .otherwise("ok")
    )


def resolve_path(base: Column | str, path: Column | str) -> Column:
    """Absolute clean form of a requested path."""
    p = column(path)
    return (
        F.when(p == "", clean_path(base))
        .when(p.startswith("/"), clean_path(p))
        .otherwise(clean_path(F.concat(column(base), F.lit("/"), p)))
    )


def relative_path(base: Column | str, path: Column | str) -> Column:
    """Resolved path relative to the project, null when outside of it."""
    root, full = clean_path(base), resolve_path(base, path)
    return F.when(full == root, ".").when(
        full.startswith(F.concat(root, F.lit("/"))),
        F.substring(full, F.length(root) + 2, F.length(full)),
    )


def display_path(base: Column | str, path: Column | str) -> Column:
    """Relative path inside the project, else the base name."""
    return F.coalesce(relative_path(base, path), base_name(resolve_path(base, path)))
