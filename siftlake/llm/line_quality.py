"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import without, written

# The white space and symbols of the rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8

OUT = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "n_removed_lines", "n_removed_words", "kept", "clean_text",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space runs as one blank."""
    line = F.regexp_replace(F.lower(line), r"[0-9]", "0")
    return F.trim(F.regexp_replace(line, SPACE, " "))


def _with_windows(rows: DataFrame) -> DataFrame:
    """`_w8`: hash of the 8 words from each position on, by doubling the span three times.

    Each step is a column of its own, as a lambda would evaluate an inlined array for each element.
    """
    rows = rows.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):
        rows = rows.withColumn(
            f"_w{2 * span}", F.expr(f"transform(_w{span}, (h, i) -> xxhash64(h, get(_w{span}, i + {span})))")
        )
    last = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    return rows.withColumn("_w8", F.slice("_w8", F.lit(1), last))


def _with_covered(rows: DataFrame) -> DataFrame:
    """`n_repeat_words`: words inside windows that occur twice or more in `_w8`."""
    repeats = F.size(F.array_distinct("_w8")) < F.size("_w8")
    pairs = F.sort_array(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(repeats, pairs))
    twice = F.expr(
        "transform(_pairs, (p, k) -> if(p.h <=> get(_pairs, k - 1).h or p.h <=> get(_pairs, k + 1).h, p.i, null))"
    )
    rows = rows.withColumn("_at", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    own = F.expr(f"transform(_at, (x, k) -> least({WINDOW}, coalesce(get(_at, k + 1) - x, {WINDOW})))")
    total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def narrow(docs: DataFrame) -> DataFrame:
    """Counts of one text and the hashes of its lines: all that later steps need.

    Columns: doc_id, _host, _content (hash of the text) and the counts; _lines holds
    (hash, words) of each line with a word, in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(
        F.col("doc_id"), host.alias("_host"), text.alias("_text"), F.xxhash64(text).alias("_content"),
        _words(text).alias("_words"),
        F.filter(F.split(text, "\n"), _has_word).alias("_full_lines"),
    )
    rows = _with_covered(_with_windows(rows))
    n = F.size("_words")
    return rows.select(
        "doc_id",
        "_host",
        "_content",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_full_lines") - F.size(F.array_distinct("_full_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            "_full_lines",
            lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(_words(x)).alias("w")),
        ).alias("_lines"),
    )


def boilerplate(rows: DataFrame, min_docs: int, share: float, max_docs: int) -> DataFrame:
    """(_host, _line) of lines in more than `min_docs` different texts of a host and more than `share` of them, or in
    more than `max_docs`.

    Copies of one text count once. The first grouping is by host, line and text, so no key is
    hot; the second adds up in each task before its shuffle.
    """
    own = F.transform("_lines", lambda x: x["h"])
    lines = rows.select("_host", "_content", F.explode(F.array_distinct(own)).alias("_line"))
    per_line = (
        lines.distinct()
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > min_docs)
    )
    per_host = rows.select("_host", "_content").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    least = F.least(F.col("_all") * share, F.lit(max_docs))
    return per_line.join(per_host, "_host").where(F.col("_n") > least).select("_host", "_line")


def quality_rules(
    docs: DataFrame,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_docs: int = 20,
    share: float = 0.001,
    keep_share: float = 0.2,
    with_text: bool = True,
    max_docs: int = 1000,
) -> DataFrame:
    """Base counts of every text, lines removed by their frequency in a host, and the verdict.

    A normalised line that more than `min_docs` different texts of its host (column `source`) contain, and
    more than `share` of them or more than `max_docs`, is removed wherever the host has it, whatever its length. A
    document is rejected when it fails the base rules, or when it is depleted: removal leaves fewer than
    `min_words` words and fewer than it takes, or less than `keep_share` of its words.

    Returns all columns of `docs` and `OUT`; input columns with those names give way. `clean_text` is
    the text less removed lines (`with_text=False` leaves it and the input text out).
    Null or empty texts have no words and fail the base rules; a null source is one host of its
    own, the same as ''; rows that repeat a doc_id are judged each by its own text; an empty table
    gives an empty result.
    """
    docs = without(docs, OUT)
    rows = written(narrow(docs), "line-quality")
    frequent = boilerplate(rows, min_docs, share, max_docs)
    # The lines of a document that are removed, as one small array for each document with any.
    flagged = (
        rows.select("doc_id", "_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_line"))
        .join(frequent, ["_host", "_line"])
        .groupBy("doc_id", "_host")
        .agg(F.collect_set("_line").alias("_removed"))
        .select(F.col("doc_id").alias("_id"), F.col("_host").alias("_h"), "_removed")
    )

    def judged(df: DataFrame) -> DataFrame:
        df = df.join(flagged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_host") == F.col("_h")), "left")
        gone = F.filter("_lines", lambda x: F.array_contains("_removed", x["h"]))
        df = df.withColumn("_gone", F.when(F.col("_removed").isNotNull(), gone))
        df = df.withColumn("n_removed_lines", F.coalesce(F.size("_gone").cast("long"), F.lit(0)))
        df = df.withColumn(
            "n_removed_words",
            F.coalesce(F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + x["w"]), F.lit(0)),
        )
        failed = (F.col("n_words") < min_words) | (
            F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
        )
        left = F.col("n_words") - F.col("n_removed_words")
        few = (left < min_words) & (left < F.col("n_removed_words"))
        depleted = (F.col("n_removed_words") > 0) & (few | (left < F.col("n_words") * keep_share))
        return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    verdict = ["base_failed", "n_removed_lines", "n_removed_words", "kept"]
    if not with_text:
        return judged(rows).select("doc_id", *counts, *verdict)
    # Verdicts meet their texts again by id and text hash; equal rows have equal verdicts.
    verdicts = judged(rows).select(
        F.col("doc_id").alias("_vid"), F.col("_content").alias("_vc"), F.col("_host").alias("_vh"),
        *counts, *verdict, "_removed",
    ).dropDuplicates(["_vid", "_vc", "_vh"])
    host = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.join(
        verdicts,
        F.col("doc_id").eqNullSafe(F.col("_vid")) & (F.xxhash64(text) == F.col("_vc")) & (host == F.col("_vh")),
    )
    kept_lines = F.filter(
        F.split("text", "\n"),
        lambda x: ~(_has_word(x) & F.array_contains("_removed", F.xxhash64(normal_line(x)))),
    )
    clean = F.when(F.col("n_removed_lines") > 0, F.array_join(kept_lines, "\n")).otherwise(F.col("text"))
    return out.withColumn("clean_text", clean).drop("_vid", "_vc", "_vh", "_removed")
