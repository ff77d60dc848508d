"""Corpora as numbered lines, read by byte ranges: no file is ever a single row or one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.operators.lines import source_lines
from siftlake.session import written_table
from siftlake.sources.tables import read_corpus

# Names by which the text reader would unpack a file. Such files can't be cut and are read whole, as they are.
PACKED = r"(?i)\.(gz|bz2|zst|lz4|snappy|deflate)$"
# Up to this many ranges (about 20 MB of rows) go to every task; more meet their lines by a shuffle.
BROADCAST_RANGES = 100_000


def _parts(path: Column, root: str) -> list[Column]:
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    rel = F.substring(path, F.instr(path, marker) + len(marker), F.length(path))
    return [
        F.split_part(rel, F.lit("/"), F.lit(1)).alias("task_id"),
        F.substring(rel, F.instr(rel, "/") + 1, F.length(rel)).alias("path"),
    ]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each range counted from 1: a task reads the ranges it has one after the other, in order."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file"), batch.column("start")
        ids = np.zeros(batch.num_rows, dtype=bool)
        ids[1:] = np.diff(file.dictionary_encode().indices.to_numpy()) != 0
        ids[1:] |= np.diff(start.to_numpy()) != 0
        first = (file[0].as_py(), start[0].as_py())
        carried = count if first == last else 0
        at = np.arange(batch.num_rows)
        begin = np.maximum.accumulate(np.where(ids, at, 0))
        no = at - begin + 1 + np.where(begin == 0, carried, 0)
        last, count = (file[-1].as_py(), start[-1].as_py()), int(no[-1])
        yield pa.RecordBatch.from_arrays([file, start, pa.array(no, pa.int64()), batch.column("value")], ["file", "start", "no", "value"])


def corpus_lines(
    spark: SparkSession,
    root: str,
    glob: str = "*",
    style: str = "split",
    broadcast_ranges: int = BROADCAST_RANGES,
) -> DataFrame:
    """`source_lines(read_corpus(...))` for files of any size: (task_id, path, line, text), `line` a long.

    Spark cuts files into byte ranges at line ends. A first pass counts lines and bytes of each range; a second numbers the
    lines inside their range and adds the lines before it. Bytes that are no UTF-8 become the replacement character, a mark
    of byte order stays, an empty file has one empty line (`split`) or none (`scanner`). Files that would be unpacked by their
    names are read whole. An empty folder gives no rows; only a single line has a limit, 2 GiB.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    # The metadata path is percent-encoded, while a plus sign is itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = (
        reader.format("text").option("lineSep", "\n").load(root)
        .select(
            name.alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_size").alias("size"),
            "value",
        )
        .where(~F.col("file").rlike(PACKED))
    )
    counted = raw.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size")
    )
    ranges = written_table(counted, "ranges")
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # Lines with their ends have the size of the file, or one more byte; three fewer where a mark was taken off.
    lacking = F.max("size").over(of_file) - F.sum("bytes").over(of_file)
    placed = ranges.select(
        "file",
        "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(of_file).alias("lines"),
        (lacking >= 2).alias("marked"),
        lacking.isin(0, 3).alias("closed"),
    )
    few = ranges.count() <= broadcast_ranges
    numbered = raw.select("file", "start", "value").mapInArrow(_number, "file string, start long, no long, value string")
    rows = numbered.join(F.broadcast(placed) if few else placed, ["file", "start"]).withColumn(
        "line", F.col("before") + F.col("no")
    )
    text = F.make_valid_utf8("value")
    if style == "scanner":
        text = F.regexp_replace(text, r"\r$", "")
    text = F.when(F.col("marked") & (F.col("line") == 1), F.concat(F.lit("\ufeff"), text)).otherwise(text)
    out = rows.select(*_parts(F.col("file"), root), "line", text.alias("text"))
    if style == "split":
        after = placed.where("start = 0 and closed").select(
            *_parts(F.col("file"), root), (F.col("lines") + 1).alias("line"), F.lit("").alias("text")
        )
        out = out.unionByName(after)
    # The reader gives no line for files that are empty or hold nothing but the mark.
    sizes = [0, 3] if style == "split" else [3]
    bare = reader.format("binaryFile").load(root).where(F.col("length").isin(sizes) & ~F.col("path").rlike(PACKED))
    bare = bare.select(
        *_parts(F.col("path"), root),
        F.lit(1).cast("long").alias("line"),
        F.when(F.col("length") == 0, "").otherwise("\ufeff").alias("text"),
    )
    read = placed.where("start = 0").select(*_parts(F.col("file"), root))
    out = out.unionByName(bare.join(read, ["task_id", "path"], "left_anti"))
    packed = read_corpus(spark, root, glob).where(F.col("path").rlike(PACKED))
    return out.unionByName(source_lines(packed, style).withColumn("line", F.col("line").cast("long")))
