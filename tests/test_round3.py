"""Parsing once, folding inside rows, results in one shuffle, states as lines, tables as folders."""

from __future__ import annotations

import json
import types

from pyspark.sql import functions as F

from siftlake.functions import jsontext
from siftlake.operators import algebra
from siftlake.plans import finding_queries, stream_queries, views
from siftlake.sources import results, tables

ARRAY = '[{"a": 1}, null, {"b": [2]}]'
TEXTS = [
    ARRAY, f" {ARRAY}\n", f"See [1].\n```\n[old]\n```\n```json\n{ARRAY}\n```", f"Found: {ARRAY} done.", f"```json{ARRAY}```",
    f"Found [x] and {ARRAY}", '{"a": [1]}', f'{{"a": {ARRAY}}}', "[1, 2]", "[]", "[ ]", "[", "]", "", "null", "true", "true\n", '"x"', "-1", "1, 2",
    "[draft]", "[true]", "[note]", '["a"] tail', "[{}", "{}", '{"a": 1} {"b": 2}', "[" + " " * 60 + '{"a": 1}]', "{" + "\n" * 50 + '"a": 1}',
    "[" + "\t" * 39 + "true]", "text [a] {b}", '[{"a": "]"}] and ]', "[[1]]", None,
]


def test_items_equal_those_of_the_text_parsed_again(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    shown = lambda c: F.to_json(F.struct(c.alias("x")))
    best = jsontext.extract_json_best("t")
    found = rows.select(
        "t",
        shown(jsontext.block_items("t")).alias("block"),
        shown(jsontext.decode_array(jsontext.extract_json_block("t"))).alias("block_again"),
        shown(jsontext.best_items("t")["items"]).alias("best"),
        shown(jsontext.decode_array(best)).alias("best_again"),
        jsontext.best_items("t").isNotNull().alias("valid"),
        jsontext.valid_json(best).alias("valid_again"),
    ).collect()
    for r in found:
        assert (r.block, r.best, r.valid) == (r.block_again, r.best_again, r.valid_again), r.t
    assert [json.loads(r.best).get("x") for r in found][:6] == [json.loads(ARRAY)] * 6


def test_meaningful_values(spark):
    texts = ['"a"', '" "', '"[]"', '"{}"', "[]", "{}", "[null]", '{"a":null}', "0", "false", "null"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(jsontext.meaningful(F.parse_json("t")).alias("m"))
    assert [r.m for r in rows.collect()] == [True, False, True, True, False, False, True, True, True, True, False]


def test_small_counts_are_built_without_a_lambda():
    text = views.items_sql({n: views.finding_sql(n) for n in views.FINDING_SQL})
    assert text.count("when n = ") == 4 and text.count(" i -> ") == 1


def _docs(spark, *rows):
    table = spark.createDataFrame(rows, "stage_id string, stage string, t string")
    return table.select("stage_id", "stage", jsontext.decode_array("t").alias("items"))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_repeats_across_documents_are_folded_and_others_not_shuffled(spark):
    one, two = '[{"type":"RCE","impact":"x"},{"type":"rce","impact":"y"}]', '[{"type":"RCE","impact":" ","origin":"late"}]'
    several = _docs(spark, ("a", "rce", one), ("b", "rce", one), ("b", "rce", two), (None, "rce", one), (None, "rce", two))
    plain = algebra.dedupe_findings(
        algebra.normalize_findings(algebra.document_findings(several, ["stage_id"])), ["stage_id"]
    )
    shown = lambda df: sorted(
        ((r.stage_id or "", r.sig, r.pos, r.impact) for r in df.select("stage_id", "sig", "pos", algebra.field("f", "impact").alias("impact")).collect())
    )
    assert shown(algebra.dedupe_documents(several, ["stage_id"])) == shown(plain)
    alone = _docs(spark, ("a", "rce", one), ("b", "rce", two))
    assert _exchanges(algebra.dedupe_documents(alone, ["stage_id"])) == 0


def test_routes_of_a_run_are_merged_in_its_row(spark):
    stages = spark.createDataFrame(
        [("s", "init", "", '[{"method":"get","path":"/a"},{"method":"GET","path":"/a","source":""}]'), ("r", "init", "", "[]"), ("r", "init", "", '[{"path":"/z"}]')],
        "stage_id string, name string, result string, output_json string",
    )
    answer = '[{"method":"GET","path":"/a","description":"new"},{"method":"PUT","path":"/b"}]'
    answers = spark.createDataFrame([("s", "gap_check", answer), ("r", "gap_check", answer)], "stage_id string, kind string, content string")
    out = algebra.finalize_routes(algebra.run_answers(stages, answers)).select("stage_id", "sig", "pos", algebra.field("f", "description").alias("d"))
    got = sorted((r.stage_id, r.sig, *r.pos, r.d) for r in out.collect())
    assert got == [("r", "GET|/a|", 1, 0, "new"), ("r", "PUT|/b|", 1, 1, ""), ("r", "|/z|", 0, 0, ""), ("s", "GET|/a|", 0, 0, "new"), ("s", "PUT|/b|", 1, 1, "")]
    alone = algebra.finalize_routes(algebra.run_answers(stages.where("stage_id = 's'"), answers.where("stage_id = 's'")))
    # Answers and stages meet; after that nothing is shuffled.
    assert "Aggregate" not in alone._jdf.queryExecution().executedPlan().toString()


def test_stored_documents_take_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [("t", "rce", 0, 1, "[1]"), ("t", "rce", 1, 1, "[2]"), ("t", "rce", 2, 0, "[]"), ("u", "xss", 0, 0, "[]"), ("v", "xss", 0, 1, "[3]")]
    results.write_stage_result(spark.createDataFrame(rows, "task_id string, stage string, part long, n long, output_json string"), path)
    stored = results.stored_stages(spark, path)
    assert _exchanges(stored) == 1
    assert {r.task_id: r.output_json for r in stored.collect()} == {"t": "[1,2]", "u": "[]", "v": "[3]"}


def test_states_as_lines(spark, tmp_path):
    path = str(tmp_path / "states")
    rows = [("rce", json.dumps({"task_id": f"t{i}", "status": "done"})) for i in range(50)] + [("rce", "{broken")]
    spark.createDataFrame(rows, "stage string, value string").coalesce(1).write.partitionBy("stage").text(path)
    back = tables.read_states(spark, path, "part-*", lines=True).select("session", "stage").collect()
    assert sorted(r.session for r in back) == sorted(f"t{i}/rce" for i in range(50)) and {r.stage for r in back} == {"rce"}


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"password = 's{i}'", "en", "web") for i in range(18)], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "one").joinpath(next(p.name for p in (tmp_path / "one").glob("part-*"))).rename(tmp_path / "single.parquet")
    v = views.Views(spark, str(tmp_path))
    for table in ("documents", "single"):
        seen = stream_queries._stream(v, table).writeStream.format("memory").queryName(table).trigger(availableNow=True).start()
        seen.awaitTermination()
        assert spark.table(table).count() == 18


def test_an_answer_is_not_parsed_in_the_join(spark):
    stages = spark.createDataFrame([("s", "rce", "", "[]")], "stage_id string, name string, result string, output_json string")
    answers = spark.createDataFrame([("s", "gap_check", "none")], "stage_id string, kind string, content string")
    out = finding_queries.finalize_errors(types.SimpleNamespace(stages=stages, answers=answers))
    assert [tuple(r) for r in out.collect()] == [("s", "gap_check", "invalid_json")]
    joins = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1:]
    assert len(joins) == 1 and "invalid_json" not in joins[0]
