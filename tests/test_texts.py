"""Findings read as texts are those read as maps of variants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftlake.functions import jsontext
from siftlake.operators import algebra, findings

FIELDS = ["type", "severity", "origin", "verification_reason", "impact", "note"]
ODD = [
    [{"type": "A", "impact": "x"}, {"type": "a ", "impact": [], "severity": "low", "note": 1e2}],
    [{"impact": "[]"}, {"impact": [], "note": {}}, {"note": "5.0", "verification_reason": " "}],
    [None, {"location": "text", "trigger": {"path": 3}, "note": 5.0}],
    [{"type": 7, "origin": " me ", "note": True, "verification_status": "Confirmed"}, {"type": "7", "note": "  "}],
    [],
]


def _docs(spark, read):
    texts = [json.dumps(items).replace("100.0", "1e2") for items in ODD] + ["[1]", '{"a": 1}', "none", '[{"a": 1}, 2]']
    rows = [(str(i), stage, t) for i, t in enumerate(texts) for stage in ("rce", "init")]
    docs = spark.createDataFrame(rows, "stage_id string, stage string, output_json string").withColumn("result", F.lit(""))
    parsed = findings.parse_findings(docs.withColumn("stage_id", F.concat_ws("-", "stage_id", "stage")), read)
    return parsed.select("stage_id", "stage", "state", "items")


def _rows(df, *names):
    return sorted(tuple(r) for r in df.select("stage_id", "sig", "pos", *names).collect())


def _as_text(df):
    return df.select("stage_id", "sig", "pos", *[algebra.field("f", n).alias(n) for n in FIELDS])


def test_texts_are_those_of_maps(spark):
    keys = ["stage_id"]
    plain, quick = (_docs(spark, r) for r in (jsontext.VARIANTS, algebra.text_reader(FIELDS)))
    assert sorted(plain.select("stage_id", "state").collect()) == sorted(quick.select("stage_id", "state").collect())
    want = _rows(_as_text(algebra.initial_findings(plain, keys)), *FIELDS)
    assert _rows(algebra.initial_findings(quick, keys, FIELDS), *FIELDS) == want

    # Every document is its own answer and reviewed by itself, its order turned.
    def groups(docs, signer):
        runs = docs.select("stage_id", "stage", F.col("items").alias("stored_items"), F.reverse("items").alias("answer_items"))
        return algebra.run_groups(runs, keys, signer)

    maps, texts = groups(plain, algebra.item_signature), groups(quick, algebra.text_signature)
    for enrich in (False, True):
        want = _rows(_as_text(algebra.gap_check_merge(maps, keys, enrich)), *FIELDS)
        assert _rows(algebra.gap_check_merge(texts, keys, enrich, FIELDS), *FIELDS) == want
    want = _rows(_as_text(algebra.revalidation_merge(maps, keys)), *FIELDS)
    assert _rows(algebra.revalidation_merge(texts, keys, FIELDS), *FIELDS) == want


def test_summary_parses_runs_once(spark):
    rows = [("s", 1, "confirmed"), ("s", 0, "rejected"), (None, 1, "confirmed")]
    final = spark.createDataFrame(rows, "stage_id string, run int, verification_status string")
    said = algebra.gap_check_summary(final, ["stage_id"])
    assert "Join" not in said._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.stage_id, r.added, r.confirmed_count, r.rejected_count) for r in said.collect()] == [("s", 1, 1, 1)]
