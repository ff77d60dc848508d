"""Files read by byte ranges give the lines of the whole file; positions without a window over a whole group."""

from __future__ import annotations

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.operators import lines
from siftlake.operators.running import positions
from siftlake.sources import ranges, tables


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(3)
    root = tmp_path_factory.mktemp("corpora") / "corpus"
    files = {
        "t1/src/a.py": "".join(rng.choice(["é", "x", "\n", "\r\n", "word ", "\U0001f600", "\r"]) for _ in range(3000)).encode(),
        "t1/src/long.py": b"a" * 500 + b"\n" + b"b" * 700 + b"\nend",
        "t1/closed.go": b"one\ntwo\n",
        "t1/open.go": b"one\r\ntwo",
        "t1/empty.go": b"",
        "t1/feeds.go": b"\n" * 400,
        "t2/mark.go": b"\xef\xbb\xbffirst\nsecond\n" + b"z\n" * 90,
        "t2/mark_open.go": b"\xef\xbb\xbffirst",
        "t2/only_mark.go": b"\xef\xbb\xbf",
        "t2/bad.go": b"a\xff\xc3\nb\xe2\x82\n\0c",
        "t2/na me+%41é.go": b"x\ny",
        "t2/packed.gz": gzip.compress(b"one\ntwo\n"),
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "t3").mkdir()
    return str(root)


@pytest.mark.parametrize("style", ["split", "scanner"])
@pytest.mark.parametrize("size", ["61", "1000", "100m"])
def test_lines_of_ranges_are_those_of_the_file(spark, corpus, style, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = ranges.corpus_lines(spark, corpus, style=style, broadcast_ranges=0 if size == "1000" else 100_000)
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = lines.source_lines(tables.read_corpus(spark, corpus), style)
    assert got == sorted(map(tuple, want.collect()))
    assert len(got) > 1000


def test_a_file_is_read_by_several_tasks(spark, corpus):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = ranges.corpus_lines(spark, corpus, "a.py")
        tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks >= 4


def test_no_files(spark, corpus):
    assert ranges.corpus_lines(spark, corpus, "*.none").count() == 0


def test_positions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(400), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = positions(df, ["k"], ["a", "b"], "at")
    groups = {}
    for k, a, b in sorted(rows):
        groups.setdefault(k, []).append((a, b))
    want = sorted((k, a, b, i + 1) for k, members in groups.items() for i, (a, b) in enumerate(members))
    assert sorted(map(tuple, got.collect())) == want
    assert positions(df.limit(0), ["k"], ["a"], "at").count() == 0


def test_tree_and_pages_have_no_window_over_a_project(spark):
    files = spark.createDataFrame([("t", f"d{i % 40}/f{i}.go", "x = 1\n" * 3) for i in range(400)], "task_id string, path string, content string")
    whole = lines.tree(files)
    cut = lines.tree(files, max_entries=17)
    assert sorted(map(tuple, cut.collect())) == sorted(tuple(r) for r in whole.collect() if r.ordinal <= 17)
    assert [r.ordinal for r in whole.orderBy("ordinal").collect()] == list(range(1, 442))
    windows = re.findall(r"Window \[.*", whole._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_part" in w for w in windows)
    every = [tuple(r) for r in lines.grep_lines(files, "x").collect()]
    order = sorted(every, key=lambda r: (r[1].replace("/", "\1"), r[2]))
    page = lines.grep_lines(files, "x", max_results=50, offset=1000).collect()
    assert sorted(map(tuple, page)) == sorted(order[1000:1050])
