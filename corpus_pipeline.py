"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontam, line_quality, line_runs, near_dup, pieces
from siftlake.llm.common import session, table, written

# SQL can't express merges of pieces, so the pipeline is tested against brute force.
ORACLE_SQL = None


def _as_documents(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs`, with `text` as their text; a column n_chars follows it."""
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col(text).alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            length = F.length(F.coalesce(F.col(text), F.lit(""))).cast(kind)
            out.append(F.when(F.col(text).eqNullSafe(F.col("_before")), F.col(c)).otherwise(length).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, less lines that are too frequent in their host.

    Documents without text fail the rules; a null source is one host; an empty table stays empty, as in all stages.
    """
    rows = line_quality.quality_rules(docs.withColumn("_before", F.col("text"))).where("kept")
    return _as_documents(rows, docs, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later copies of repeated runs of lines; those that lose every word go.

    A run counts from 50 words on. Documents without text lose nothing and stay.
    """
    rows = line_runs.dedup_lines(docs.withColumn("_before", F.col("text")))
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(rows.where(~F.coalesce(emptied, F.lit(False))), docs, "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 85 percent on, as `op7_near_dup` does.

    Documents without words are in no group and stay; of rows with equal id and text one stays.
    """
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark: under a twentieth of their words.

    Documents without words stay; an empty benchmark removes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces and the text decoded from them; null reads as empty."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is a written table of the shared folder."""
    docs = table(session(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
