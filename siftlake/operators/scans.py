"""Rule scans over files: static rules, secrets, routes, release scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import labels, paths, text
from siftlake.operators.lines import any_of, files_matching, source_lines


def static_files(files: DataFrame) -> DataFrame:
    """Files the static scan reads."""
    return files.filter(
        paths.extension("path").isin(dims.STATIC_EXTENSIONS) & ~paths.in_unscanned_directory("path")
    )


def static_scan(
    files: DataFrame, rules: list[tuple] = dims.STATIC_RULES, max_line_bytes: int | None = None
) -> DataFrame:
    """One finding per (line, rule) match, in lines of any length unless `max_line_bytes` is given.

    Few rules are folded into the scan as literals: no rule join, each pattern
    compiled once per task, and files without any match are never split.
    """
    patterns = [r[0] for r in rules]
    lines = source_lines(files_matching(static_files(files), patterns)).filter(F.col("text").rlike(any_of(patterns)))
    if max_line_bytes is not None:
        lines = lines.filter(F.octet_length("text") <= max_line_bytes)
    found = F.array(
        *[F.when(F.col("text").rlike(text.regex(pattern)), F.lit(i)) for i, (pattern, *_) in enumerate(rules)]
    )
    hits = lines.withColumn("rule", F.explode(F.array_compact(found)))

    def of_rule(position: int) -> Column:
        return F.get(F.array(*[F.lit(r[position]) for r in rules]), F.col("rule"))

    return hits.select(
        "task_id",
        "path",
        "line",
        F.col("rule").alias("rule_no"),
        of_rule(1).alias("type"),
        of_rule(2).alias("subtype"),
        of_rule(3).alias("severity"),
        of_rule(4).alias("description"),
        text.trim_all("text").alias("vulnerable_code"),
    )


def static_rule_counts(files: DataFrame, rules: list[tuple] = dims.STATIC_RULES) -> DataFrame:
    """Every rule with its number of findings and of files, zeros kept."""
    table = files.sparkSession.createDataFrame(
        [(i, r[1], r[2], r[3]) for i, r in enumerate(rules)],
        "rule_no int, type string, subtype string, severity string",
    )
    counts = (
        static_scan(files, rules)
        .groupBy("rule_no")
        .agg(F.count("*").alias("findings"), F.count_distinct("task_id", "path").alias("files"))
    )
    return table.join(counts, "rule_no", "left").fillna(0, ["findings", "files"])


def static_stage_items(found: DataFrame) -> DataFrame:
    """Static findings as the items of each project's `static_scan` stage: (task_id, stage, pos, item JSON).

    `pos` orders them by path, line and rule; `tables.stage_documents` makes documents of them.
    """
    item = F.struct(
        "type",
        "subtype",
        "severity",
        F.struct(F.col("path").alias("file"), F.col("line").cast("string").alias("line")).alias("location"),
        F.struct(F.lit("").alias("method"), F.lit("").alias("path")).alias("trigger"),
        "description",
        "vulnerable_code",
    )
    pos = F.struct("path", "line", "rule_no")
    return found.select("task_id", F.lit("static_scan").alias("stage"), pos.alias("pos"), F.to_json(item).alias("item"))


def release_scope(files: DataFrame) -> DataFrame:
    """Publishable files."""
    return files.filter(~paths.release_excluded("path"))


def _secret_rule(rule: str, pattern: str, group: int) -> Column:
    line, pattern = F.col("text"), text.regex(pattern)
    if group == 0:
        return F.when(line.rlike(pattern), F.lit(rule))
    # Only the first match of a line is looked at.
    value = F.regexp_extract(line, pattern, group)
    return F.when(line.rlike(pattern) & ~labels.is_placeholder(value), F.lit(rule))


def secret_scan(files: DataFrame) -> DataFrame:
    """(task_id, path, line, rule, excerpt); empty and NUL-containing files are skipped."""
    patterns = [p for _, p, _ in dims.SECRET_RULES]
    content = F.col("content")
    readable = files.filter((content != "") & ~F.contains(content, F.lit("\0")))
    lines = source_lines(files_matching(readable, patterns), "scanner").filter(
        F.col("text").rlike(any_of(patterns))
    )
    hits = F.array_compact(F.array(*[_secret_rule(*rule) for rule in dims.SECRET_RULES]))
    return lines.select(
        "task_id", "path", "line", F.explode(hits).alias("rule"), text.trim_all("text").alias("excerpt")
    )


def secret_gate(files: DataFrame) -> DataFrame:
    """Per project: published files, secrets in them, and whether it passes."""
    scope = release_scope(files)
    counts = scope.groupBy("task_id").agg(F.count("*").alias("file_count"))
    secrets = secret_scan(scope).groupBy("task_id").agg(F.count("*").alias("secrets"))
    return counts.join(secrets, "task_id", "left").select(
        "task_id",
        "file_count",
        F.coalesce("secrets", F.lit(0)).alias("secrets"),
        F.col("secrets").isNull().alias("passes"),
    )


def archive_summary(entries: DataFrame) -> DataFrame:
    """Per archive over (task_id, path, is_dir, content): files, unexpected entries, secrets."""
    flagged = entries.withColumn("unexpected", paths.release_excluded("path", F.col("is_dir")))
    shape = flagged.groupBy("task_id").agg(
        F.count_if(~F.col("is_dir")).alias("file_count"), F.count_if("unexpected").alias("unexpected_count")
    )
    secrets = (
        secret_scan(flagged.filter(~F.col("is_dir") & ~F.col("unexpected")))
        .groupBy("task_id")
        .agg(F.count("*").alias("secret_count"))
    )
    return shape.join(secrets, "task_id", "left").fillna(0, ["secret_count"])


def unexpected_entries(entries: DataFrame) -> DataFrame:
    """Archive entries that must not be published."""
    return entries.filter(paths.release_excluded("path", F.col("is_dir"))).select(
        "task_id", paths.clean_path("path").alias("path")
    )


def route_candidates(files: DataFrame, rules: list[tuple[str, str]] = dims.ROUTE_RULES) -> DataFrame:
    """Lines that look like route registrations: (task_id, path, line, framework, method, route, text)."""
    patterns = [p for _, p in rules]
    lines = source_lines(files_matching(files, patterns), "scanner").filter(
        F.col("text").rlike(any_of(patterns))
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("text").rlike(text.regex(pattern)),
                    F.struct(
                        F.lit(name).alias("framework"),
                        F.regexp_extract("text", text.regex(pattern), 0).alias("matched"),
                    ),
                )
                for name, pattern in rules
            ]
        )
    )
    rows = lines.select("task_id", "path", "line", "text", F.explode(hits).alias("hit"))
    verb = F.upper(F.regexp_extract("hit.matched", r"(?i)(get|post|put|delete|patch)", 1))
    return rows.select(
        "task_id",
        "path",
        "line",
        F.col("hit.framework").alias("framework"),
        F.when(verb == "", "ANY").otherwise(verb).alias("method"),
        F.regexp_extract("text", "[\"'](/[^\"']*)[\"']", 1).alias("route"),
    )
