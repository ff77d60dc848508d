"""Quality rules and line dedup against plain versions."""

from __future__ import annotations

import random

import pytest

from siftlake.llm import line_quality, line_runs
from siftlake.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, n_words string, kept int"
SF = "/root/testdata/sf0.001"


def odd_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n ", None), (4, "one", None), (None, prose(40), "a")]
    for i in range(30):  # a short line in many texts of one host, in few of another
        rows.append((10 + i, f"Subscribe  NOW {i % 10}!\n" + prose(25) + "\n" + prose(8), "a" if i < 26 else "b"))
    rows += [(50, "subscribe now 4!\n" + prose(6), "a"), (51, "subscribe now 4!\n" * 4 + prose(30), "a")]
    rows.append((52, "".join(f"subscribe now {i}!\n" for i in range(6)) + prose(10), "a"))
    rows += [(60 + i, "a copied line\n" + "copy " * 40, "c") for i in range(40)]  # one text: counts once
    for n in (31, 45, 49, 50, 55, 300):  # notices of any length
        notice = " ".join(f"n{n}x{k}" for k in range(n))
        rows += [(1000 * n + i, f"{notice}\n" + " ".join(f"z{i}y{k}" for k in range(60)), "e") for i in range(21 + n % 2)]
    rows.append((120, ("again and again it says the very same thing " * 9), "d"))
    rows.append((121, "x " * 5000 + "\n" + prose(6000), "d"))
    rows += [(122, "tie\x0bté ß x # *\r\n" + prose(30), "d")] * 2
    return rows


def test_quality_rules(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    out = line_quality.quality_rules(df)
    assert sorted(out.columns) == sorted({"doc_id", "source", "text", *line_quality.OUT})
    got = sorted(
        (
            r.doc_id or 0, r.source or "", r.text or "", r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
            r.n_repeat_words, r.base_failed, r.n_removed_lines, r.n_removed_words, r.kept, r.clean_text or "",
        )
        for r in out.collect()
    )
    want = sorted(
        (d or 0, s or "", t or "", *n, failed, lines, lost, kept, clean or "")
        for (d, t, s), (n, failed, lines, lost, kept, clean) in zip(rows, brute.quality(rows))
    )
    assert got == want
    assert any(w[9] for w in want) and any(not w[8] and not w[11] for w in want)


def test_quality_rules_empty_and_bare(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_quality.quality_rules(empty).count() == 0
    bare = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert line_quality.quality_rules(bare, with_text=False).first().base_failed


def test_quality_long_and_very_common_lines(spark):
    def rows(n_words, host):
        line = " ".join(f"notice{k}" for k in range(n_words))
        return [(i, f"{line}\n" + " ".join(f"{host}x{i}y{k}" for k in range(60)), host) for i in range(25)]

    schema = "doc_id long, text string, source string"
    for n_words in (31, 49, 50, 55, 4000):
        df = spark.createDataFrame(rows(n_words, "a"), schema)
        assert {r.n_removed_lines for r in line_quality.quality_rules(df).collect()} == {1}
    # In a large host the share alone would ask for more texts than any bound.
    df = spark.createDataFrame(rows(9, "a"), schema)
    judged = line_quality.quality_rules(df, share=1.0, max_docs=24)
    assert {r.n_removed_lines for r in judged.collect()} == {1}


def test_quality_plan_is_native(spark):
    plan = QUERIES["op6_line_quality"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_line_runs(spark, min_words):
    rng = random.Random(min_words)
    lines = ["", "a b", "c", "d e f", "g h i j", " ", "k l m n o p"]
    rows = [(1, None), (2, ""), (3, "\n\n")]
    for i in range(60):
        rows.append((10 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))))
    rows += [(90, "c\n" * 200), (91, "c\n" * 150 + "d e f")]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, clean_text string, at int")
    out = line_runs.dedup_lines(df.repartition(3), min_words=min_words)
    got = {r.doc_id: (r.removed_lines, r.clean_text, r.n_lines, r.n_removed_lines, r.at) for r in out.collect()}
    for (d, t), gone in zip(rows, brute.line_runs(rows, min_words)):
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in set(gone)]
        clean = t if not gone else "\n".join(kept)
        assert got[d] == (gone, clean, len((t or "").split("\n")), len(gone), 0), d


def test_line_runs_odd_ids(spark):
    text = "one two three\nfour five six"
    schema = "doc_id long, text string"
    rows = [(None, text), (5, text), (5, text), (5, "seven\n" + text)]
    out = line_runs.dedup_lines(spark.createDataFrame(rows, schema), min_words=6).collect()
    assert len(out) == 4 and sum(r.n_removed_lines for r in out) == 6  # all copies but that of the null id
    assert [r.n_removed_lines for r in out if r.doc_id is None] == [0]
    assert line_runs.dedup_lines(spark.createDataFrame([], schema)).count() == 0
