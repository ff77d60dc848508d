"""Report roll-ups that read each document once, and a stream whose triggers use all cores."""

from __future__ import annotations

import pandas as pd

from siftlake.functions import jsontext
from siftlake.operators import findings, report, rollup
from siftlake.plans import stream_queries
from siftlake.plans.views import Views
from siftlake.streaming import streams

STAGES = "stage_id string, task_id string, name string, status string, result string, output_json string, created_at timestamp, updated_at timestamp"
TASKS = "task_id string, name string, remark string, status string, created_at timestamp, result string, output_json string"


def _stages(spark, rows):
    """(stage_id, task_id, name, output_json, day) as completed stages."""
    at = [pd.Timestamp(f"2024-01-0{day}").to_pydatetime() for *_, day in rows]
    return spark.createDataFrame(
        [(i, t, n, "completed", "", doc, a, a) for (i, t, n, doc, _), a in zip(rows, at)], STAGES
    )


def _tasks(spark, ids):
    return spark.createDataFrame([(i, i, "", "completed", None, "", "[]") for i in ids], TASKS)


def test_stage_cards_choose_the_first_document_in_the_shuffle_of_the_join(spark):
    stages = _stages(
        spark,
        [("s1", "t", "rce", '[{"a": 1}, 2, null]', 2), ("s2", "t", "rce", "[]", 1), ("s3", "t", "xss", "  \t[1, 2]\n", 1), ("s4", "t", "notes", "[1]", 1)],
    )
    cards = rollup.stage_cards(_tasks(spark, ["t"]), stages)
    got = {r.stage: (r.finding_count, r.detail) for r in cards.collect() if r.finding_count is not None}
    assert got == {"rce": (0, "clean"), "xss": (2, "findings")}
    plan = cards._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join") == 1


def test_ui_items_as_texts_take_elements_of_any_kind(spark):
    stages = _stages(
        spark, [("s", "t", "rce", '[{"severity": "Low", "location": {"file": 88.0}}, 7, null, {"location": {"file": "[]"}}]', 1)]
    )
    (row,) = findings.ui_items(stages, report.UI_TEXTS).select("items", "has_payload").collect()
    assert [(x.t.severity or "", (x.t.location and x.t.location.file) or "") for x in row["items"]] == [("Low", "88"), ("", ""), ("", ""), ("", "[]")]
    assert row.has_payload
    (seen,) = report.ui_report_overview(_tasks(spark, ["t"]), stages).collect()
    assert (seen.total_findings, seen.unique_files, seen.low, seen.high) == (4, 2, 1, 3)


def test_report_fields_read_documents_once(spark):
    item = (
        '{"component_name": "lib", "component_version": "2", "a_list": ["x", " ", 3], "like_list": "[1]", "empty": [], "blank": " ",'
        ' "score": 1e1, "said": "2.0", "none": null, "whole": 7.0, "config": {"k": [1]}, "component": "own", "type": "T"}'
    )
    documents = report.report_documents(_stages(spark, [("s", "t", "config", f"[{item}]", 1)]), report.DETAILS)
    fields = report.report_fields(documents)
    got = {(r.section, r.key): r.value for r in fields.collect()}
    assert {k: v for (section, k), v in got.items() if section == 2} == {
        "a_list": "x\n3", "like_list": "[1]", "score": "10", "said": "2.0", "whole": "7", "component": "own",
        "config": got[(2, "config")],
    }
    assert got[(2, "config")].replace(" ", "").replace("\n", "") == '{"k":[1]}'
    assert got[(0, "component")] == "lib @ 2" and len(got) == 8
    assert "Union" not in fields._jdf.queryExecution().optimizedPlan().toString()
    variants = report.report_documents(_stages(spark, [("s", "t", "config", f"[{item}]", 1)]), jsontext.VARIANTS)
    assert sorted(report.report_fields(variants).collect()) == sorted(fields.collect())


def test_a_trigger_of_the_memory_stream_takes_files_for_all_cores(spark, tmp_path, monkeypatch):
    asked = []
    plain = streams.stream_transcript

    def seen(spark, path, files_per_trigger=100):
        asked.append(files_per_trigger)
        return plain(spark, path, files_per_trigger)

    monkeypatch.setattr(streams, "stream_transcript", seen)
    view = Views(spark, str(tmp_path))
    view.__dict__["messages"] = spark.sql(
        "select concat('u', id % 3) as session, id as seq, 'normal' as kind, repeat('x', 10) as content,"
        " cast(null as array<struct<id: string, name: string, arguments: string>>) as tool_calls, cast(null as timestamp) as created_at from range(30)"
    )
    rows = stream_queries.stream_memory_delta(view).collect()
    assert sorted((r.session, r.growth_bytes, r.last_seq) for r in rows) == [("u0", 100, 27), ("u1", 100, 28), ("u2", 100, 29)]
    assert asked == [spark.sparkContext.defaultParallelism]


def test_partial_growth_keeps_outcomes(spark):
    rows = pd.DataFrame(
        {"session": ["a", None, "a", "b"], "growth_bytes": [1, 2, 3, 4], "tool_calls": [0, 1, 2, 3], "last_seq": [1, 2, 3, 4], "outcomes": ["1:2:1", "9:9:0", "3:4:0", ""]}
    )
    (out,) = streams._partial_growth(iter([rows]))
    got = {s if isinstance(s, str) else None: tuple(x) for s, *x in out.itertuples(index=False)}
    assert got == {"a": (4, 2, 3, "1:2:1,3:4:0"), "b": (4, 3, 4, ""), None: (2, 1, 2, "9:9:0")}
