"""Searches through an index find what the scan finds and read less."""

from __future__ import annotations

import random
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from siftlake.functions import grams
from siftlake.operators import lines
from siftlake.session import work_folder
from siftlake.sources import gram_index

FILES = "task_id string, path string, content string"


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "TOKEN", "été", "x", "(", "0x1f"]
    rows = [
        (f"t{i % 3}", f"src/d{i % 7}/f{i}.{'go' if i % 2 else 'py'}", "".join(
            rng.choice(words) + rng.choice([" ", "\n", "", "\r\n"]) for _ in range(rng.randrange(12))))
        for i in range(300)
    ]
    rows += [("t0", "vendor/a.go", "alpha"), ("t0", "n.go", None), ("t0", "e.go", ""), ("t0", "k.go", "rareword\n" * 3), ("t0", "k.go", "rareword")]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def index(spark, files):
    path = work_folder(spark, "index")
    gram_index.write_file_index(files, path, blocks=8)
    return path


PATTERNS = [
    "alphabeta", "(?:alpha|Beta)gamma", "TOKEN.*delta", "x+", "^gamma", "ÉTÉ", "tok(en|yo)", "nothing here", r"\balpha\b",
    "(alpha ){2}", "bet(a|b)(g|d)", "",
]


@pytest.mark.parametrize(("named", "patterns"), [(0, PATTERNS[:2]), (10_000, PATTERNS)])
def test_equal_to_the_scan(spark, files, index, named, patterns, monkeypatch):
    monkeypatch.setattr(gram_index.indexed_rows, "__defaults__", (named,))
    cases = [(pattern, fold) for pattern in patterns for fold in (False, True)]

    def both(case):
        want = sorted(map(tuple, lines.grep_lines(files, *case).collect()))
        return want == sorted(map(tuple, gram_index.grep_indexed(spark, index, *case).collect()))

    with ThreadPoolExecutor(6) as pool:
        assert [case for case, same in zip(cases, pool.map(both, cases)) if not same] == []


def test_only_possible_files_are_read(spark, files, index):
    total = files.count()
    counts = {p: gram_index.indexed_rows(spark, index, p).count() for p in ("rareword", "alphabeta", "nothing here", "a")}
    assert counts["rareword"] == 2 and counts["nothing here"] == 0 and counts["a"] == total
    assert 0 < counts["alphabeta"] < total / 3
    plan = gram_index.indexed_rows(spark, index, "rareword")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan
    assert "row_no" in plan.split("PushedFilters")[1]


def test_rows_are_added(spark, files):
    path = work_folder(spark, "index")
    part = files.where("task_id <> 't1'")
    gram_index.write_file_index(part, path, blocks=4)
    gram_index.write_file_index(files.where("task_id = 't1'"), path, blocks=4)
    assert gram_index.grep_indexed(spark, path, "gamma").count() == lines.grep_lines(files, "gamma").count()


def test_empty_index(spark, files):
    path = work_folder(spark, "index")
    gram_index.write_file_index(files.limit(0), path)
    assert gram_index.grep_indexed(spark, path, "gamma").count() == 0
    assert gram_index.grep_indexed(spark, path, "a").count() == 0


def test_paths(spark, files):
    path = work_folder(spark, "index")
    gram_index.write_path_index(files, path, blocks=4)
    for glob in ("*.go", "**/src/d1/*", "f1?.py", "t0", "src/*/f2*.go", "*", "[ef]*.go"):
        want = sorted(map(tuple, lines.search_paths(files, glob).collect()))
        assert sorted(map(tuple, gram_index.search_indexed(spark, path, glob).collect())) == want, glob


@pytest.mark.parametrize("pairs", [1, 40, 1 << 20])
def test_listed_grams(pairs):
    texts = ["", "ab", "abc", "ABCabc", None, "été 😀😀😀", "x" * 9, "abcdefghij" * 5, "\n\0\t "]
    batch = pa.RecordBatch.from_pydict({"row_no": pa.array(range(len(texts)), pa.int32()), "value": texts})
    got = {(r["gram"], n) for b in grams.listed(iter([batch, batch.slice(3, 2)]), pairs) for r in b.to_pylist() for n in r["row_nos"]}
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert got == {(t[i : i + 3], n) for n, t in enumerate(fold) for i in range(len(t) - 2)}
    for piece in (1, 2, 7):
        assert [grams.distinct(t, piece).tolist() for t in fold] == [grams.distinct(t).tolist() for t in fold]
