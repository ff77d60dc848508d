"""The registered queries of this package, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import (
    byte_cnn,
    conversation_repair,
    decontam,
    host_rank,
    html_text,
    lexical_search,
    license_scan,
    line_quality,
    line_runs,
    near_dup,
    oracle,
    pieces,
    secret_layers,
    token_count,
)
from siftlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and line frequency over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_quality.quality_rules(docs, with_text=False)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces with an end id, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_documents(docs))


@query
def op1_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents and of the layers encoded in them."""
    found = secret_layers.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_layers.joined("base"), 256).alias("base_sha256"),
        secret_layers.joined("spans").alias("spans"),
        "n_layers",
        "n_refused",
    )


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines of all documents, and what is left of the texts."""
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed_lines",
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


@query
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return byte_cnn.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op10_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return host_rank.filter_pages(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query
def op11_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, the cheapest edits that repair them, and what they become."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(convs, conversation_repair.damage(convs))


@query
def op12_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
