"""A stored index of grams for repeated searches: which rows can match a pattern, without reading the others.

`write_index` stores rows in blocks by a hash of their keys, and postings (gram, rows) in buckets by gram. A search
turns its pattern into a formula of grams, reads the buckets of those grams and then only the blocks and row groups of
the rows that make the formula true; a pattern that names no gram reads everything. The search itself is the plain one over
those rows, so an index changes what is read, never what is found.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import grams, patterns, text
from siftlake.operators import lines

BUCKETS = 64
# Up to this many rows are named in the scan's filter; more are met by a semi join.
NAMED_ROWS = 10_000


def write_index(
    rows: DataFrame, path: str, value: str | Column, keys: tuple = ("task_id", "path"), blocks: int = 256
) -> None:
    """Add rows and the postings of all grams of `value` to the index at `path`.

    Rows with equal keys share a number of 32 bits, and so may others: they are read and searched as well. A null value has no
    postings. Each task lists the rows of its grams before the shuffle, in lists of bounded length; blocks and buckets are
    cut into several files where they are large, so a gram that most rows hold is no task of its own.
    """
    spark = rows.sparkSession
    row_no = F.hash(*keys)
    numbered = rows.withColumns({"row_no": row_no, "block": F.pmod(row_no, F.lit(blocks)).cast("int")})
    # Folders of an empty index hold no file that names the columns.
    numbered.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    (
        numbered.hint("rebalance", "block")
        .sortWithinPartitions("block", "row_no")
        .write.mode("append")
        .partitionBy("block")
        .parquet(f"{path}/rows")
    )
    texts = numbered.select("row_no", text.column(value).alias("value"))
    postings = texts.mapInArrow(grams.listed, "gram string, row_nos array<int>")
    postings = postings.withColumns({"blocks": F.lit(blocks), "bucket": (F.crc32("gram") % BUCKETS).cast("int")})
    (
        postings.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "gram")
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )


def possible_rows(spark: SparkSession, path: str, known) -> DataFrame:
    """(row_no, block) of the rows whose grams make the formula true."""
    named = patterns.leaves(known)
    buckets = sorted({zlib.crc32(gram.encode()) % BUCKETS for gram in named})
    stored = spark.read.schema("gram string, row_nos array<int>, blocks int, bucket int")
    postings = stored.parquet(f"{path}/postings")
    return (
        postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(named))
        .select("gram", F.explode("row_nos").alias("row_no"), "blocks")
        .groupBy("row_no", F.pmod("row_no", "blocks").alias("block"))
        .agg(F.collect_set("gram").alias("_found"))
        .where(patterns.holds(known, F.col("_found")))
        .select("row_no", "block")
    )


def indexed_rows(spark: SparkSession, path: str, pattern: str, named_rows: int = NAMED_ROWS) -> DataFrame:
    """The stored rows that can match a pattern: all of those that do, and few others."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    known = patterns.formula(pattern)
    if known is True:
        return rows.drop("row_no", "block")
    possible = possible_rows(spark, path, known)
    few = possible.limit(named_rows + 1).collect()
    if len(few) > named_rows:
        found = rows.join(possible, ["row_no", "block"], "left_semi")
    else:
        # Literals reach the scan: folders of other blocks and row groups of other numbers aren't read.
        found = rows.where(
            F.col("block").isin(sorted({r["block"] for r in few})) & F.col("row_no").isin([r["row_no"] for r in few])
        )
    return found.drop("row_no", "block")


def write_file_index(files: DataFrame, path: str, blocks: int = 256) -> None:
    """Index the contents of (task_id, path, content)."""
    write_index(files, path, "content", blocks=blocks)


def grep_indexed(
    spark: SparkSession,
    path: str,
    pattern: str,
    ignore_case: bool = False,
    max_results: int | None = None,
    offset: int = 0,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """`lines.grep_lines` over an index of files."""
    # The formula is the same with and without case, but flags decide whether letters outside A-Z fold.
    possible = indexed_rows(spark, path, f"(?i){pattern}" if ignore_case else pattern)
    return lines.grep_lines(possible, pattern, ignore_case, max_results, offset, max_file_bytes=max_file_bytes)


def write_path_index(files: DataFrame, path: str, blocks: int = 256) -> None:
    """Index the paths and names of files and their directories."""
    write_index(lines.path_entries(files), path, F.concat_ws("\n", "path", "name"), blocks=blocks)


def search_indexed(
    spark: SparkSession, path: str, pattern: str, max_results: int | None = None, offset: int = 0
) -> DataFrame:
    """`lines.search_paths` over an index of paths."""
    return lines.search_entries(indexed_rows(spark, path, text.glob_to_regex(pattern)), pattern, max_results, offset)
