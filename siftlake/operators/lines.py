"""Files as lines, and the listing operators: grep, search, list, tree, read range.

A `files` table has (task_id, path, content); `path` is relative to the project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import paths, text
from siftlake.operators.running import positions


def split_lines(content: Column, style: str = "split") -> Column:
    """Array of lines.

    `split` keeps a trailing empty line and carriage returns, `scanner` drops both.
    """
    parts = F.split(content, "\n")
    if style == "split":
        return parts
    bare = F.when(content.endswith("\n") | (content == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(
        F.contains(content, F.lit("\r")), F.transform(bare, lambda s: F.regexp_replace(s, r"\r$", ""))
    ).otherwise(bare)


def source_lines(files: DataFrame, style: str = "split") -> DataFrame:
    """(task_id, path, line, text), lines numbered from 1."""
    rows = files.select("task_id", "path", F.posexplode(split_lines(F.col("content"), style)).alias("pos", "text"))
    return rows.select("task_id", "path", (F.col("pos") + 1).alias("line"), "text")


def line_local(pattern: str) -> bool:
    """True when a match inside a line is also a match inside the whole file."""
    bare = pattern.replace("[^", "[")
    return not any(token in bare for token in ("^", "$", r"\A", r"\z", r"\Z", r"\G", "(?<", "(?=", "(?!"))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{text.regex(p)})" for p in patterns)


def files_matching(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop files without a match before they are split, where that is safe."""
    if all(line_local(p) for p in patterns):
        return files.filter(F.col("content").rlike(any_of(patterns)))
    return files


def ranked(
    rows: DataFrame, order: list, keys: list[str], limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Rows offset+1 .. offset+limit of every group; all rows when neither is given.

    For first rows the rank filter lets Spark cut each group before the shuffle, so a hot
    group sends at most `limit` rows per input partition. Later pages (`order` names columns) are
    found by their positions, which no task counts over a whole group.
    """
    if limit is None and not offset:
        return rows
    if offset:
        placed = positions(rows, keys, order, "rank")
        last = F.lit(True) if limit is None else F.col("rank") <= offset + limit
        return placed.filter((F.col("rank") > offset) & last).drop("rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def grep_lines(
    files: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    max_results: int | None = None,
    offset: int = 0,
    max_files: int | None = None,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Matching lines per project with the text as shown (cut at 100 bytes).

    Every line of every walked file is looked at. A caller may ask for a page in walk
    order (`max_results`, `offset`), for the first files only, or for small files only.
    """
    regex = f"(?i){pattern}" if ignore_case else pattern
    path = F.col("path")
    walked = files.filter(~paths.in_ignored_directory(path)).withColumn("walk", paths.walk_key(path))
    readable = walked.filter(
        ~paths.extension(path).isin(dims.GREP_SKIPPED_EXTENSIONS) & ~F.contains(path, F.lit(".git/"))
    )
    if max_file_bytes is not None:
        readable = readable.filter(F.octet_length("content") <= max_file_bytes)
    hits = (
        files_matching(readable, [regex])
        .select(
            "task_id",
            "path",
            "walk",
            F.posexplode(split_lines(F.col("content"), "scanner")).alias("pos", "line_text"),
        )
        .filter(F.col("line_text").rlike(text.regex(regex)))
    )
    if max_files is not None:
        # The file limit counts every walked file, also those skipped above.
        last = (
            ranked(walked.select("task_id", "walk"), ["walk"], ["task_id"], 1, max_files - 1)
            .withColumnRenamed("walk", "last_walk")
        )
        hits = hits.join(last, "task_id", "left").filter(
            F.col("last_walk").isNull() | (F.col("walk") <= F.col("last_walk"))
        )
    page = ranked(hits, ["walk", "pos"], ["task_id"], max_results, offset)
    return page.select(
        "task_id",
        "path",
        (F.col("pos") + 1).alias("line"),
        text.cut_bytes(text.trim_all("line_text"), 100, "...").alias("shown"),
    )


def path_entries(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files and their directories outside ignored directories: (task_id, path, name, depth, is_dir).

    The project root is the entry `.` named after the task; empty directories
    are unknown to a file table.
    """
    parts = F.split("path", "/")
    deepest = F.size(parts) if max_depth is None else F.least(F.size(parts), F.lit(max_depth))
    steps = files.select("task_id", parts.alias("parts"), F.explode(F.sequence(F.lit(0), deepest)).alias("depth"))
    entries = steps.select(
        "task_id",
        "depth",
        F.slice("parts", F.lit(1), F.col("depth")).alias("own"),
        (F.col("depth") < F.size("parts")).alias("is_dir"),
    )
    ignored = F.array(*[F.lit(n) for n in dims.IGNORED_DIRECTORIES])
    directories = F.when(F.col("is_dir"), F.col("own")).otherwise(
        F.slice("own", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    )
    return (
        entries.filter(~F.arrays_overlap(directories, ignored))
        .groupBy(
            "task_id",
            F.when(F.col("depth") == 0, ".").otherwise(F.array_join("own", "/")).alias("path"),
            "depth",
        )
        .agg(F.max("is_dir").alias("is_dir"))
        .withColumn("name", F.when(F.col("depth") == 0, F.col("task_id")).otherwise(paths.base_name("path")))
    )


def _walk_order() -> Column:
    return F.when(F.col("depth") == 0, "").otherwise(paths.walk_key("path"))


def search_paths(files: DataFrame, pattern: str, max_results: int | None = None, offset: int = 0) -> DataFrame:
    """Files and directories whose base name (or path, when the glob has `/`) matches."""
    return search_entries(path_entries(files), pattern, max_results, offset)


def search_entries(entries: DataFrame, pattern: str, max_results: int | None = None, offset: int = 0) -> DataFrame:
    """`search_paths` over entries that are already there."""
    regex = text.glob_to_regex(pattern)
    target = "path" if "/" in pattern.removeprefix("**/") else "name"
    hits = entries.filter(F.col(target).rlike(regex)).withColumn("walk", _walk_order())
    return ranked(hits, ["walk"], ["task_id"], max_results, offset).select("task_id", "path", "is_dir")


def list_children(files: DataFrame, directory: str = "", max_entries: int | None = None) -> DataFrame:
    """Immediate children of a directory: kind D or F, name, size (null for directories)."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    inside = files.filter(F.col("path").startswith(prefix)).select(
        "task_id",
        F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"),
        F.contains(rest, F.lit("/")).alias("is_dir"),
        F.octet_length("content").alias("bytes"),
    )
    entries = (
        inside.groupBy("task_id", "name")
        .agg(F.max("is_dir").alias("is_dir"), F.max("bytes").alias("bytes"))
        .filter(~(F.col("is_dir") & F.col("name").isin(dims.IGNORED_DIRECTORIES)))
    )
    return ranked(entries, ["name"], ["task_id"], max_entries).select(
        "task_id",
        F.when(F.col("is_dir"), "D").otherwise("F").alias("kind"),
        "name",
        F.when(~F.col("is_dir"), F.col("bytes")).alias("bytes"),
    )


def tree(files: DataFrame, max_depth: int = 2, max_entries: int | None = None) -> DataFrame:
    """Depth-limited tree, two spaces per level, root included, in walk order (`ordinal`)."""
    entries = path_entries(files, max_depth).withColumn("walk", _walk_order())
    if max_entries is None:
        shown = positions(entries, ["task_id"], ["walk"], "ordinal")
    else:
        rank = F.row_number().over(Window.partitionBy("task_id").orderBy("walk"))
        shown = entries.withColumn("ordinal", rank.cast("long")).filter(F.col("ordinal") <= max_entries)
    kind = F.when(F.col("is_dir"), "[D] ").otherwise("[F] ")
    return shown.select(
        "task_id",
        "ordinal",
        "path",
        "depth",
        F.concat(F.repeat(F.lit("  "), F.col("depth")), kind, F.col("name")).alias("shown"),
    )


def _effective_ranges(
    requests: DataFrame, files: DataFrame, auto_lines: int | None, open_lines: int | None
) -> DataFrame:
    """Requests with the lines of their file, effective first/last line and a status.

    Only requested files are split into lines.
    """
    start, end = F.col("start_line"), F.col("end_line")
    auto = (start <= 0) & (end <= 0)
    total = F.col("total_lines")
    first = F.greatest(start, F.lit(1))
    to_auto = total if auto_lines is None else F.lit(auto_lines)
    to_open = total if open_lines is None else first + open_lines
    asked = requests.select("task_id", "path").distinct()
    wanted = files.join(asked, ["task_id", "path"], "left_semi").select("task_id", "path", "content")
    lines = split_lines(F.col("content"), "scanner")
    return (
        requests.join(wanted, ["task_id", "path"], "left")
        .withColumn("lines", lines)
        .withColumn("total_lines", F.when(F.col("content").isNotNull(), F.size("lines")))
        .withColumn("first", first)
        .withColumn("last", F.when(auto, to_auto).when(end <= 0, to_open).otherwise(end))
        .withColumn(
            "status",
            F.when(total.isNull(), "missing")
            .when(~auto & (end > 0) & (F.col("first") > end), "bad_range")
            .when(total < F.col("first"), "short")
            .otherwise("ok"),
        )
    )


def read_range_status(
    requests: DataFrame, files: DataFrame, auto_lines: int | None = None, open_lines: int | None = None
) -> DataFrame:
    """One row per request: effective range, file length, ok / missing / bad_range / short.

    A request without a range means the whole file, or its first `auto_lines`; one
    without an end means the rest of the file, or `open_lines` more.
    """
    return _effective_ranges(requests, files, auto_lines, open_lines).select(
        "request_id", "task_id", "path", "first", "last", "total_lines", "status"
    )


def read_range(
    requests: DataFrame,
    files: DataFrame,
    max_bytes: int | None = None,
    auto_lines: int | None = None,
    open_lines: int | None = None,
) -> DataFrame:
    """Lines of the requested ranges, cut out of each file in its own row: lines are never shuffled.

    `requests` has (request_id, task_id, path, start_line, end_line). With
    `max_bytes` the output ends with the line that passes it.
    """
    wanted = _effective_ranges(requests, files, auto_lines, open_lines).filter(F.col("status") == "ok")
    count = F.least("last", "total_lines") - F.col("first") + 1
    part = F.slice("lines", F.col("first").cast("int"), F.greatest(count, F.lit(0)).cast("int"))
    rows = wanted.select("request_id", "task_id", "path", "first", F.posexplode(part).alias("at", "text"))
    rows = rows.select("request_id", "task_id", "path", (F.col("first") + F.col("at")).alias("line"), "text")
    if max_bytes is None:
        return rows
    # One request reads one file, so this window never spans more than a file.
    before = Window.partitionBy("request_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    written = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return rows.withColumn("written", written).filter(F.col("written") <= max_bytes).drop("written")
