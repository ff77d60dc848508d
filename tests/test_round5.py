"""Findings read as texts in whole, fenced blocks in one pass, report stages without shuffled documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from siftlake.functions import jsontext
from siftlake.operators import algebra, findings, report, rollup
from siftlake.plans import catalog

DOCS = "stage_id string, stage string, result string, output_json string"
TEXTS = ["type", "severity", "impact", "verification_status"]
ODD = (
    '[{"type": "A", "impact": "x", "severity": "low"}, {"type": "a ", "impact": [], "severity": "high", "verification_status": "Confirmed"},'
    ' null, {"location": "text", "trigger": {"path": 3}, "impact": 5.0}, {"impact": "{}"}, {"impact": 1e1}]'
)


def _docs(spark, rows, read=jsontext.VARIANTS):
    docs = spark.createDataFrame([(i, "rce", "", doc) for i, doc in rows], DOCS)
    return findings.parse_findings(docs, read).select("stage_id", "stage", "items")


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_normalized_and_signed_texts_are_those_of_maps(spark):
    rows = [("a", ODD), ("b", "[]"), ("c", "[1]"), ("d", '[{"type": "B", "severity": "odd"}]')]
    maps = algebra.normalize_findings(algebra.document_findings(_docs(spark, rows), ["stage_id"]))
    want = _sorted(maps.select("stage_id", "pos", "sig", *[algebra.field("f", n) for n in TEXTS]))
    quick = algebra.document_findings(_docs(spark, rows, algebra.text_reader(TEXTS)), ["stage_id"], fields=TEXTS)
    normal = algebra.normalize_findings(quick, fields=TEXTS)
    assert _sorted(normal.select("stage_id", "pos", "sig", *TEXTS)) == want
    signed = algebra.document_findings(_docs(spark, rows, algebra.text_reader([])), ["stage_id"], fields=[])
    assert _sorted(signed.select("stage_id", "pos", "sig")) == [w[:3] for w in want]


def test_repeated_documents_fold_as_texts(spark):
    rows = [("a", ODD), ("a", ODD), ("b", '[{"type": "B", "impact": "one"}]'), ("b", '[{"type": "C"}, {"type": "B", "impact": "two"}]'), ("c", ODD)]
    maps = algebra.dedupe_documents(_docs(spark, rows), ["stage_id"])
    want = _sorted(maps.select("stage_id", "pos", "sig", *[algebra.field("f", n) for n in TEXTS]))
    quick = algebra.dedupe_documents(_docs(spark, rows, algebra.text_reader(TEXTS)), ["stage_id"], TEXTS)
    assert _sorted(quick.select("stage_id", "pos", "sig", *TEXTS)) == want


def test_field_texts_are_all_fields_of_all_elements(spark):
    stages = spark.createDataFrame([("a", "rce", "", ODD), ("b", "rce", "", '[{"k": null, "l": [1, "x"]}]'), ("c", "rce", "", "[1]")], DOCS)
    got = findings.field_texts(stages)
    items = findings.parse_findings(stages).select("stage_id", F.explode("items").alias("item"))
    want = items.select("stage_id", F.explode(jsontext.payload("item")).alias("key", "value"))
    want = want.select("stage_id", "key", jsontext.to_text("value"))
    trimmed = F.regexp_replace(F.coalesce("value", F.lit("")), r"\.0$", "")
    assert _sorted(got.select("stage_id", "key", trimmed)) == _sorted(want)


def test_elements_are_printed_once_to_find_odd_ones(spark):
    docs = _docs(spark, [("a", ODD)], algebra.text_reader(TEXTS))
    assert "concat_ws" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_those_of_the_lazy_pattern(spark):
    lazy = re.compile(r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```")
    texts = [
        "a\n```json\n[1, [2], {\"a\": \"]\"}]\n```\n```\n{\"b\": {}}\n```", "```[a] ```json [b] x ] ```", "```[open ``` [x]```", "```json{a}b}```c```{d}```",
        "```[a]\n\n``` ]```", "``````[]```", "no fence [1]", "```json [1] {2} ```", "```{]}```[}]```",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.b for r in df.select("t", jsontext._blocks(F.col("t")).alias("b")).collect()}
    assert got == {t: lazy.findall(t)[::-1] if "```" in t else None for t in texts}
    assert ".*?" not in jsontext._BLOCK


def test_report_stages_choose_among_narrow_rows(spark):
    schema = "stage_id string, task_id string, name string, status string, result string, output_json string, created_at timestamp, updated_at timestamp"
    at = [pd.Timestamp(f"2024-01-0{day}").to_pydatetime() for day in (1, 2, 3)]
    item = '{"location": {"file": "f", "line": 1}, "trigger": {"path": "/p"}}'
    rows = [
        ("s1", "t", "rce", "completed", "", "[]", at[0], at[0]),
        ("s2", "t", "rce", "Completed", "", f"[{item}, {item}, {{}}]", at[1], at[1]),
        ("s2", "t", "rce", "completed", "", f"[{item}]", at[1], at[2]),
        ("s3", "u", "rce", "completed", "", "[{}]", at[0], at[0]),
        ("s4", "u", "rce", "running", "", "[{}]", at[1], at[0]),
        ("s5", "u", "xss", "completed", "a note", "", at[1], at[0]),
        (None, "w", "xss", "completed", "a note", "", at[1], at[0]),
    ]
    stages = spark.createDataFrame(rows, schema)
    documents = report.report_documents(stages, report.TEXTS)
    shown = report.report_stages(documents)
    got = {(r.stage_id, r.finding_count, r.unique_files, r.unique_interfaces, r.raw_text) for r in shown.collect()}
    assert got == {("s2", 4, 1, 1, None), ("s5", 0, 0, 0, "a note")}
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "LeftSemi" not in plan
    old = report.report_documents(stages, jsontext.VARIANTS)
    assert _sorted(documents.select("stage_id", "stage", "state")) == _sorted(old.select("stage_id", "stage", "state"))


def test_roll_ups_read_texts_of_any_element(spark):
    schema = "stage_id string, task_id string, name string, status string, result string, output_json string"
    doc = '[{"severity": "low"}, null, {"severity": 1e1, "reviewed_severity": " critical "}, {"verification_status": " Rejected"}]'
    rows = rollup.stage_rows(spark.createDataFrame([("s", "t", "rce", "completed", "", doc), ("u", "t", "rce", "completed", "x", "")], schema))
    got = sorted((r.stage_id, r.pos or 0, r.is_first, r.is_active, r.severity) for r in rows.collect())
    assert got == [
        ("s", 0, True, True, "LOW"), ("s", 1, False, True, "HIGH"), ("s", 2, False, True, "CRITICAL"), ("s", 3, False, False, "HIGH"),
        ("u", 0, True, False, "HIGH"),
    ]


def test_stages_of_long_texts_run_as_split_methods(spark, tmp_path):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.range(3).selectExpr("id as event_id", "'view' as event_type", "'x' as props").write.parquet(f"{tmp_path}/events.parquet")
        catalog.QUERIES["repair_tool_args"](spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
