"""Streams with Spark's own keyed state against the batch forms."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlake import schemas
from siftlake.operators import scans, transcript
from siftlake.streaming import streams
from tests.test_goldens import messages_df


def log(spark, seed, n=200):
    rng = random.Random(seed)
    rows = [{"role": rng.choice(["user", "assistant"]), "content": "y" * rng.randint(0, 90), "calls": ["a"] * rng.randint(0, 1),
             "kind": rng.choice(["normal", "normal", "compact_boundary"])} for _ in range(n)]
    return messages_df(spark, *rows).withColumn("session", F.when(F.col("seq") % 7 == 0, "small").otherwise("hot"))


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("files", [1, 3, 10])
def test_memory_stream_equals_batch(spark, files, tmp_path):
    m = log(spark, files)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    m.repartition(files).write.json(source)
    arrived = streams.stream_transcript(spark, source, files_per_trigger=1)
    streams.drain(streams.stream_memory_delta(arrived, 3000, 30, restart=False), path)
    rows = streams.memory_rows(spark, f"{path}-checkpoint", 3000, 30)
    got = {r.session: (r.growth_bytes, r.tool_calls, r.last_seq, r.fires) for r in rows.collect()}
    states = spark.createDataFrame([], schemas.STATES)
    batch = transcript.memory_delta(m, states, 3000, 30).collect()
    assert got == {r.session: (r.growth_bytes, r.tool_calls, int(r.last_id[1:]), r.fires) for r in batch}
    due = {r.session for r in spark.read.schema(streams.MEMORY_OUTPUT).parquet(path).collect()}
    assert due == {r.session for r in batch if r.fires}


def test_memory_stream_restarts_and_cools_down(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def say(n, *rows):
        made = messages_df(spark, *[{"role": "user", "content": "y" * 100, "calls": ["a"], "kind": k} for k, _ in rows])
        times = F.element_at(F.array(*[F.lit(t).cast("timestamp") for _, t in rows]), F.col("i"))
        ordered = made.withColumn("i", F.row_number().over(Window.orderBy("seq")))
        ordered.withColumn("created_at", times).drop("i").withColumn("seq", F.col("seq") + 100 * n).withColumn("session", F.lit(f"s{n % 2}")).coalesce(1).write.mode("append").json(source)
        time.sleep(1.1)  # files are taken up by their time

    soon = now + dt.timedelta(seconds=20)
    say(0, ("normal", now), ("normal", now))  # due, then from 0 again
    say(2, ("normal", now), ("memory_failed", soon))
    say(4, ("normal", now))  # enough, but cooling down
    say(1, ("memory_failed", now), ("memory_updated", now), ("normal", now), ("normal", now))  # the cooldown has ended
    arrived = streams.stream_transcript(spark, source, files_per_trigger=1)
    due = streams.stream_memory_delta(arrived, 200, 2, cooldown_seconds=5)
    query = (
        due.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
        .trigger(processingTime="1 second").start()
    )
    read = lambda: sorted(tuple(r) for r in spark.read.schema(streams.MEMORY_OUTPUT).parquet(path).collect())
    try:
        end, seen = time.time() + 120, []
        while time.time() < end and len(seen) < 3:
            time.sleep(1)
            seen = read() if os.path.isdir(path) else []
    finally:
        query.stop()
    # The second of s0 came when the cooldown was over, and no message came with it.
    assert dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) >= soon + dt.timedelta(seconds=5)
    assert [(r[0], r[1], r[2]) for r in seen] == [("s0", 200, 2), ("s0", 200, 2), ("s1", 200, 2)]


def test_logs_go_out_in_twos_or_after_seconds(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "session string, seq long, entry string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    put(("a", 1, "one"), ("b", 1, "alone"), ("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z"))
    logs = spark.readStream.schema(schema).json(source)
    read = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect())
    streams.log_microbatch(logs, path, check, drain=True).awaitTermination()
    assert read() == [("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z")]
    assert sorted(tuple(r) for r in streams.pending_logs(spark, check).collect()) == [("a", 1, "one"), ("b", 1, "alone")]
    put(("a", 2, "two"))  # a restarted query goes on with what was pending
    streams.log_microbatch(logs, path, check, drain=True).awaitTermination()
    assert [r for r in read() if r[0] == "a"] == [("a", 1, "one"), ("a", 2, "two")]
    assert [tuple(r) for r in streams.pending_logs(spark, check).collect()] == [("b", 1, "alone")]
    quick, out = str(tmp_path / "check2"), str(tmp_path / "out2")
    query = streams.log_microbatch(logs, out, quick, seconds=3)
    try:
        end, got = time.time() + 90, []
        while time.time() < end and len(got) < 6:
            time.sleep(1)
            got = spark.read.schema(schema).parquet(out).collect() if os.path.isdir(out) else []
    finally:
        query.stop()
    assert sorted(map(tuple, got)) == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "alone"), ("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z")]


def test_state_does_not_grow_with_batches(spark, tmp_path):
    sizes = []
    for files in (4, 16):
        source, path = str(tmp_path / f"in{files}"), str(tmp_path / f"out{files}")
        log(spark, 1, 160).repartition(files).write.json(source)
        arrived = streams.stream_transcript(spark, source, files_per_trigger=1)
        streams.drain(streams.stream_memory_delta(arrived, 10**9, 10**9), path)
        rows = streams.memory_rows(spark, f"{path}-checkpoint")
        sizes.append((rows.count(), sum(r.growth_bytes for r in rows.collect())))
        assert size_of(path) < 20_000  # nothing was due, so the sink holds its log alone
    assert sizes[0] == sizes[1]


def test_a_file_that_comes_again_is_reported_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "task_id string, path string, content string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    put(("t", "a.php", "eval(1)"), ("t", "a.php", "eval(1)"), ("u", "a.php", "eval(1)"))
    put(("t", "a.php", "eval(1)"), ("t", "b.php", "md5(2)"))
    put(("t", "a.php", "eval(1);\neval(2)"), ("t", "c.php", None))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    streams.drain(streams.stream_static_scan(files), path)
    got = sorted((r.task_id, r.path, r.line) for r in spark.read.parquet(path).collect())
    assert got == [("t", "a.php", 1), ("t", "a.php", 1), ("t", "a.php", 2), ("t", "b.php", 1), ("u", "a.php", 1)]
    once = spark.read.schema(schema).json(source).distinct()
    assert scans.static_scan(once).count() == streams.stream_static_scan(once).count() == len(got)
