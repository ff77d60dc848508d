"""Rule scans whose rules are rows of a table: lines meet only the rules that share a gram with them.

`scans` folds a list of few rules into the plan. A table of thousands is joined instead: each rule is stored under
grams of which every matching line holds one, each line looks its grams up, and the pattern is tried on what meets.
Rules whose patterns name no gram are folded into scans of all lines, so no line meets rules by a cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import labels, patterns, text
from siftlake.operators.lines import any_of, source_lines
from siftlake.operators.scans import static_files
from siftlake.session import written_table

# Rules stored under at most this many grams go to every task (some ten megabytes); more are joined by shuffle.
BROADCAST_GRAMS = 100_000
# Rules without a gram that one scan tries on its lines.
FOLDED = 100


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules with their Java form `regex` and their `cover` of grams, null for patterns that name none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rules.schema)}, regex string, cover array<string>"

    def compile_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["regex"] = [text.regex(p) for p in batch["pattern"]]
            batch["cover"] = [patterns.cover(patterns.formula(p)) for p in batch["pattern"]]
            yield batch

    return written_table(rules.where("pattern is not null").mapInPandas(compile_batch, schema), "rules")


def rule_hits(
    lines: DataFrame, rules: DataFrame, column: str = "text", broadcast_grams: int = BROADCAST_GRAMS
) -> DataFrame:
    """Every (line, rule) whose text matches the rule's pattern: the columns of both, and `regex`.

    `rules` has `pattern` and any columns that `lines` has not; each of its rows counts, also equal ones. Lines and
    patterns that are null match nothing, an empty side gives no rows, a pattern that Java cannot read is an error. The number
    of grams is counted before the join is chosen. Beyond `broadcast_grams` the join is a shuffle by gram, of lines
    that a filter of the rules' grams lets through; adaptive execution splits grams that many lines have.
    """
    compiled = compiled_rules(rules)
    keep = [c for c in compiled.columns if c != "cover"]
    stored = compiled.where("cover is not null").withColumn("_gram", F.explode("cover"))
    if stored.count() <= broadcast_grams:
        stored = F.broadcast(stored)
    looked_up = lines.withColumn("_gram", F.explode(patterns.grams(column)))
    shared = F.filter("cover", lambda g: F.contains(patterns.folded(column), g))
    found = (
        looked_up.join(stored, "_gram")
        # A line that shares several grams with a rule meets it once.
        .where((F.size("cover") == 1) | (F.array_min(shared) == F.col("_gram")))
        .where(F.rlike(F.col(column), F.col("regex")))
        .select(*lines.columns, *keep)
    )
    gramless = compiled.where("cover is null").select("pattern").distinct().toPandas()["pattern"].tolist()
    for start in range(0, len(gramless), FOLDED):
        found = found.unionByName(_folded(lines, compiled, sorted(gramless)[start : start + FOLDED], column, keep))
    return found


def _folded(lines: DataFrame, compiled: DataFrame, some: list[str], column: str, keep: list[str]) -> DataFrame:
    """Hits of some patterns that are literals of the plan; hits meet their rules by pattern."""
    matched = F.array(*[F.when(F.col(column).rlike(text.regex(p)), F.lit(p)) for p in some])
    hits = lines.where(F.col(column).rlike(any_of(some))).withColumn("pattern", F.explode(F.array_compact(matched)))
    return hits.join(compiled.drop("cover"), "pattern").select(*lines.columns, *keep)


def static_scan_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """`scans.static_scan` with rules (rule_no, pattern, type, subtype, severity, description) as a table."""
    hits = rule_hits(source_lines(static_files(files)), rules)
    about = ["rule_no", "type", "subtype", "severity", "description"]
    return hits.select("task_id", "path", "line", *about, text.trim_all("text").alias("vulnerable_code"))


def static_rule_table(rules: list[tuple] = dims.STATIC_RULES, first: int = 0) -> list[tuple]:
    """A list of rules as rows of a rule table, numbered in order."""
    return [(first + i, *rule) for i, rule in enumerate(rules)]


def secret_scan_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """`scans.secret_scan` with rules (rule, pattern, value_group) as a table; group 0 looks at no value."""
    content = F.col("content")
    readable = files.where((content != "") & ~F.contains(content, F.lit("\0")))
    hits = rule_hits(source_lines(readable, "scanner"), rules)
    value = F.call_function("regexp_extract", F.col("text"), F.col("regex"), F.col("value_group"))
    return hits.where((F.col("value_group") == 0) | ~labels.is_placeholder(value)).select(
        "task_id", "path", "line", "rule", text.trim_all("text").alias("excerpt")
    )


def route_candidates_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """`scans.route_candidates` with rules (framework, pattern) as a table."""
    hits = rule_hits(source_lines(files, "scanner"), rules)
    matched = F.call_function("regexp_extract", F.col("text"), F.col("regex"), F.lit(0))
    verb = F.upper(F.regexp_extract(matched, r"(?i)(get|post|put|delete|patch)", 1))
    return hits.select(
        "task_id",
        "path",
        "line",
        "framework",
        F.when(verb == "", "ANY").otherwise(verb).alias("method"),
        F.regexp_extract("text", "[\"'](/[^\"']*)[\"']", 1).alias("route"),
    )
