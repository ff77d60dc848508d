"""Queries that run as streams over the driver's tables and read their sinks back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.plans.corpus_queries import EXTRA_RULES, STATIC
from siftlake.plans.finding_queries import LOGS_SQL
from siftlake.plans.registry import query
from siftlake.plans.transcript_queries import M
from siftlake.plans.views import FILES_SQL, Views, cte
from siftlake.session import drop_at_end, work_folder
from siftlake.streaming import streams


def _stream(v: Views, table: str) -> DataFrame:
    """A driver table, one file or a folder of files, as a file stream."""
    schema = v.spark.read.parquet(f"{v.sf_dir}/{table}.parquet").schema
    # As a pattern the path may be a file, which a plain path of a stream may not.
    return v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/{table}[.]parquet")


def _view(v: Views, text: str, table: str, stream: DataFrame) -> DataFrame:
    return v.spark.sql(text, **{table: stream})


def _drop(v: Views, *folders: str) -> None:
    """What a query wrote only to read it back goes when the application ends."""
    for folder in folders:
        drop_at_end(v.spark, folder)
        drop_at_end(v.spark, f"{folder}-checkpoint")


@query("stream_static_scan", f"{STATIC} select * from hits")
def stream_static_scan(v: Views):
    files = _view(v, FILES_SQL, "documents", _stream(v, "documents"))
    path = work_folder(v.spark, "stream-scan")
    # Every file arrives twice and is reported once.
    twice = files.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_twice")
    streams.drain(streams.stream_static_scan(twice, EXTRA_RULES), path)
    _drop(v, path)
    return v.spark.read.parquet(path)


@query(
    "stream_transcript",
    f"{M} select session, count(*) as messages, sum(strlen(content))::bigint as bytes, sum(n_calls)::bigint as calls from m group by all",
)
def stream_transcript(v: Views):
    source, path = work_folder(v.spark, "stream-in"), work_folder(v.spark, "stream-transcript")
    v.messages.write.json(source)
    arrived = streams.stream_transcript(v.spark, source)
    slim = arrived.select(
        "session", F.octet_length("content").alias("b"), F.coalesce(F.size("tool_calls"), F.lit(0)).alias("c")
    )
    streams.drain(slim, path)
    _drop(v, source, path)
    return (
        v.spark.read.parquet(path)
        .groupBy("session")
        .agg(F.count("*").alias("messages"), F.sum("b").alias("bytes"), F.sum("c").alias("calls"))
    )


@query("log_microbatch", f"{cte(g=LOGS_SQL)} select user_id, seq, entry from g")
def log_microbatch(v: Views):
    path = work_folder(v.spark, "stream-logs")
    logs = _view(v, LOGS_SQL, "events", _stream(v, "events"))
    logs = logs.select(F.col("user_id").cast("string").alias("session"), "seq", "entry")
    streams.log_microbatch(logs, path, f"{path}-checkpoint", drain=True).awaitTermination()
    _drop(v, path)
    # What is pending at the end is in the state: each entry is in one of the two places.
    flushed = v.spark.read.schema("session string, seq bigint, entry string").parquet(path)
    rows = flushed.unionByName(streams.pending_logs(v.spark, f"{path}-checkpoint"))
    return rows.select(F.col("session").cast("bigint").alias("user_id"), "seq", "entry")


@query(
    "stream_memory_delta",
    f"""{M}, x as (select session, sum(strlen(content))::bigint as growth_bytes, sum(n_calls)::bigint as tool_calls, max(seq) as last_seq
      from m where kind not in ('compact_boundary', 'microcompact_event') group by all)
    select *, growth_bytes >= 1000 and tool_calls >= 2 as fires from x""",
)
def stream_memory_delta(v: Views):
    source, path = work_folder(v.spark, "stream-in"), work_folder(v.spark, "stream-memory")
    # The log arrives in three triggers, each of as many files as tasks run at once; without restarts the state ends
    # where the batch form does.
    files = max(2, v.spark.sparkContext.defaultParallelism)
    v.messages.repartition(3 * files).write.json(source)
    arrived = streams.stream_transcript(v.spark, source, files_per_trigger=files)
    streams.drain(streams.stream_memory_delta(arrived, 1000, 2, restart=False), path)
    _drop(v, source, path)
    return streams.memory_rows(v.spark, f"{path}-checkpoint", 1000, 2)
