"""Structured Streaming forms: transcripts, logs, memory deltas, static scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siftlake import dims, schemas
from siftlake.operators import scans

MEMORY_OUTPUT = "session string, growth_bytes bigint, tool_calls bigint, last_seq bigint"


def stream_transcript(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages as they are appended to a folder of JSON lines."""
    return (
        spark.readStream.schema(schemas.MESSAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("mode", "FAILFAST")
        .json(path)
    )


class _Flush(StatefulProcessor):
    """Pending log entries of one session: `size` of them go out at once, fewer after `seconds` (None: not before)."""

    def __init__(self, size: int, seconds: int | None):
        self.size, self.seconds = size, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "seq bigint, entry string")

    def _out(self, key: tuple, rows: list[tuple], timers: list[int]) -> pd.DataFrame:
        self.pending.clear()
        for timer in timers:
            self.handle.deleteTimer(timer)
        return pd.DataFrame({"session": key[0], "seq": [r[0] for r in rows], "entry": [r[1] for r in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.pending.get())
        timers = [] if self.seconds is None else list(self.handle.listTimers())
        for part in rows:
            held += zip(part["seq"].tolist(), part["entry"].tolist())
        if len(held) >= self.size:
            yield self._out(key, sorted(held, key=lambda r: r[0]), timers)
        elif held:
            self.pending.put(held)
            if not timers and self.seconds is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.pending.get())
        if held:
            yield self._out(key, sorted(held, key=lambda r: r[0]), [])

    def close(self) -> None:
        pass


def flushed_logs(logs: DataFrame, size: int = 2, seconds: int | None = 3) -> DataFrame:
    """(session, seq, entry) of a stream of log entries, as they are flushed.

    A session's entries go out together once `size` of them are pending, or `seconds` after the first pending one came,
    whichever is earlier. Pending entries and timers live in Spark's state store, so a restarted query goes on with
    them and storage does not grow with the number of batches. Time is that of processing, so no entry is ever late.
    A stream with timers never runs out of batches; one that shall end with its input takes `seconds=None`.
    """
    _keyed_state(logs.sparkSession)
    rows = logs.select("session", "seq", "entry")
    return rows.groupBy("session").transformWithStateInPandas(
        _Flush(size, seconds), "session string, seq bigint, entry string", "append", "none" if seconds is None else "processingTime"
    )


def log_microbatch(
    logs: DataFrame, path: str, checkpoint: str, size: int = 2, seconds: int = 3, drain: bool = False
):
    """Append log entries to `path` as `flushed_logs` lets them go; with `drain` take up what is there and end, without timers.

    Entries still pending when the query ends are those of `pending_logs`.
    """
    writer = flushed_logs(logs, size, None if drain else seconds).writeStream.format("parquet").option("path", path)
    trigger = {"availableNow": True} if drain else {"processingTime": "1 second"}
    return writer.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def pending_logs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, seq, entry) that a query of `log_microbatch` has taken up and not flushed."""
    _keyed_state(spark)
    held = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    return held.select("key.session", "list_element.seq", "list_element.entry")


class _Growth(StatefulProcessor):
    """Growth of one session since its last memory update, its failures and when it may fire again."""

    def __init__(self, min_growth: int, min_calls: int, cooldown: int, restart: bool):
        self.min_growth, self.min_calls, self.cooldown, self.restart = min_growth, min_calls, cooldown, restart

    def init(self, handle) -> None:
        self.handle = handle
        fields = "growth_bytes bigint, tool_calls bigint, last_seq bigint, failures bigint, blocked_until bigint"
        self.state = handle.getValueState("growth", fields)

    def _fired(self, key: tuple, growth: int, calls: int, last: int, failures: int, until: int, now: int) -> Iterator[pd.DataFrame]:
        """Store the state; a row where both thresholds hold and no cooldown does."""
        fires = growth >= self.min_growth and calls >= self.min_calls and now >= until
        if fires:
            yield pd.DataFrame({"session": [key[0]], "growth_bytes": [growth], "tool_calls": [calls], "last_seq": [last]})
        if fires and self.restart:
            growth = calls = 0
        self.state.update((growth, calls, last, failures, until))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        growth, calls, last, failures, until = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0)
        now = timerValues.getCurrentProcessingTimeInMs() if self.cooldown else 0
        for part in rows:
            growth, calls = growth + int(part["growth_bytes"].sum()), calls + int(part["tool_calls"].sum())
            last = max([last, *part["last_seq"].dropna().astype("int64")])
            for seq, at, failed in sorted(x for xs in part["outcomes"] for x in _outcomes(xs)):
                failures = failures + 1 if failed else 0
                until = at + 1000 * self.cooldown if failed and self.cooldown else 0
        if self.cooldown:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if until > now:
                self.handle.registerTimer(until)
        yield from self._fired(key, growth, calls, last, failures, until, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._fired(key, *self.state.get(), now)

    def close(self) -> None:
        pass


def _outcomes(text: str) -> list[tuple[int, int, bool]]:
    """(seq, time in ms, failed) of each outcome."""
    return [(int(s), int(t), f == "1") for s, t, f in (x.split(":") for x in text.split(",") if x)]


def _partial_growth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each session of a batch, so few rows of a busy session are shuffled."""
    for batch in batches:
        # Outcomes are rare, and joining texts takes a call for each session.
        said = (batch["outcomes"] != "").any()
        joined = {"outcomes": ("outcomes", lambda x: ",".join(o for o in x if o))} if said else {}
        out = batch.groupby("session", as_index=False, dropna=False).agg(
            growth_bytes=("growth_bytes", "sum"), tool_calls=("tool_calls", "sum"), last_seq=("last_seq", "max"), **joined
        )
        yield out if said else out.assign(outcomes="")


def stream_memory_delta(
    messages: DataFrame,
    min_growth: int = dims.MEMORY_MIN_GROWTH_BYTES,
    min_calls: int = dims.MEMORY_MIN_TOOL_CALLS,
    cooldown_seconds: int = 0,
    restart: bool = True,
) -> DataFrame:
    """(session, growth_bytes, tool_calls, last_seq) whenever a session's memory is due.

    `messages` is a stream of (session, seq, kind, content, tool_calls, created_at). Counters of a session live in Spark's
    state store. It is due once both thresholds hold; with `restart` its counters then start again. A message of kind
    `memory_failed` says that an update failed at its created_at: the session isn't due for `cooldown_seconds` from then
    on, and a timer looks again when they are over; one of kind `memory_updated` ends the cooldown. Time is that of
    processing, so no message is ever late; a stream with a cooldown never runs out of batches. Each task adds its rows up by session before the shuffle.
    `memory_rows` reads the counters.
    """
    _keyed_state(messages.sparkSession)
    outcome = F.col("kind").isin(dims.MEMORY_FAILED_KIND, dims.MEMORY_UPDATED_KIND)
    shown = ~F.col("kind").isin(dims.BOUNDARY_KIND, dims.MICROCOMPACT_KIND) & ~outcome
    ms = F.coalesce(F.unix_millis("created_at"), F.lit(0))
    failed = F.when(F.col("kind") == dims.MEMORY_FAILED_KIND, "1").otherwise("0")
    slim = messages.filter(shown | outcome).select(
        "session",
        F.when(shown, F.coalesce(F.octet_length("content"), F.lit(0))).otherwise(0).cast("long").alias("growth_bytes"),
        F.when(shown, F.coalesce(F.size("tool_calls"), F.lit(0))).otherwise(0).cast("long").alias("tool_calls"),
        F.when(shown, F.col("seq")).otherwise(0).alias("last_seq"),
        F.when(outcome, F.concat_ws(":", "seq", ms, failed)).otherwise("").alias("outcomes"),
    )
    kinds = "session string, growth_bytes long, tool_calls long, last_seq long, outcomes string"
    sums = slim.mapInPandas(_partial_growth, kinds)
    return sums.groupBy("session").transformWithStateInPandas(
        _Growth(min_growth, min_calls, cooldown_seconds, restart), MEMORY_OUTPUT, "append", "processingTime" if cooldown_seconds else "none"
    )


def memory_rows(
    spark: SparkSession,
    checkpoint: str,
    min_growth: int = dims.MEMORY_MIN_GROWTH_BYTES,
    min_calls: int = dims.MEMORY_MIN_TOOL_CALLS,
) -> DataFrame:
    """The counters of every session in the state of a query of `stream_memory_delta`, and whether they would fire."""
    _keyed_state(spark)
    held = spark.read.format("statestore").option("stateVarName", "growth").load(checkpoint)
    rows = held.select("key.session", "value.*")
    fires = (F.col("growth_bytes") >= min_growth) & (F.col("tool_calls") >= min_calls)
    return rows.select("session", "growth_bytes", "tool_calls", "last_seq", fires.alias("fires"))


def _keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    kind = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get(name, None) != kind:
        spark.conf.set(name, kind)


def stream_static_scan(
    files: DataFrame, rules: list[tuple] = dims.STATIC_RULES, arrived: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """The static scan over newly arrived files; on a table that is no stream, the batch scan.

    A file that comes again with the same content within `delay` is scanned once. Its key (task, path, hash of the
    content) is forgotten after that, so state stays bounded; a change of content is a new file. Files are stamped
    when the stream takes them up, so none is ever late. With `arrived`, a timestamp column of the caller's, a file
    stamped more than `delay` before the latest one seen is late and left to the batch scan.
    """
    if files.isStreaming:
        stamp = F.current_timestamp() if arrived is None else F.col(arrived)
        keyed = files.withColumns({"_arrived": stamp, "_content": F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)})
        once = keyed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["task_id", "path", "_content"])
        files = once.drop("_arrived", "_content")
    return scans.static_scan(files, rules)


def drain(stream: DataFrame, path: str) -> None:
    """Run a stream over everything there is and append the result as parquet; the checkpoint stands beside it."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    query = writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
