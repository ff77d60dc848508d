"""Documents with many elements or beyond the variant limit, and JSON in noisy text, against plain versions."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftlake.functions import jsontext
from siftlake.operators import algebra, findings, rollup
from tests.test_goldens import ROUTES, T0, stages_df, tasks_df


def valid(text):
    def no_constant(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=no_constant)
        return True
    except (ValueError, RecursionError):
        return False


def leftmost(text, opener, closer):
    """The rule itself: every opener in turn, up to the last closer."""
    end = text.rfind(closer)
    for at in range(end):
        if text[at] == opener and valid(text[at : end + 1]):
            return text[at : end + 1]
    return None


def test_slice_is_the_leftmost_valid_one(spark):
    rng = random.Random(1)
    signs = ["[", "]", "{", "}", '"', "\\", ",", "1", '"a"', '"a":', "[]", "{}", '"]"', '"\\""', '"[\\\\"', " ", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for _ in range(600):
        value = json.dumps([{"k]": "v[\"", "n": [1, {"é": "\\"}]}][: rng.randint(0, 1)] or [[], "]"])
        noise = "".join(rng.choice(signs) for _ in range(rng.randint(0, 6)))
        texts.append(noise + value + rng.choice(["", " tail", '"', '\\"x']))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for opener, closer in ("[]", "{}"):
        found = jsontext._if_valid(jsontext._matched_slice(F.col("t"), opener, closer))
        got = {r.i: r.found for r in rows.select("i", found.alias("found")).collect()}
        want = {i: leftmost(t, opener, closer) for i, t in enumerate(texts)}
        assert got == want
        assert sum(w is not None for w in want.values()) > 200


def test_many_openers_take_linear_time(spark):
    text = "[ see " * 50_000 + "x" * 600_000 + ' [{"type":"XSS"}] done'
    rows = spark.createDataFrame([(text,)], "t string")
    begin = time.time()
    assert rows.select(jsontext.extract_json_best("t")).first()[0] == '[{"type":"XSS"}]'
    assert time.time() - begin < 15


SAMPLES = [
    '[{"a":1,"b":[1,2,{"c":"]"}]},null,{}]', "[]", "[1,2]", '["{}"]', '[{"a":1}] tail', '[{"a":1}],[2]', '[{"a":1]', '{"a":[1]}',
    "null", "prose [x]", '```json\n[{"severity":"low"}]\n```', 'Said: [{"a":"\\u00e9 \\" ]"}] done.', '{"a":1,"a":2}', '[{"a":1,"a":2}]',
    ' [ {"big":12345678901234567890,"f":1.50} ] ', '[{"a":01}]', "[{'a':1}]", '[{"a":NaN}]', "[{a:1}]", "[{}] // x", '[{"a":1,}]', "[{}", '[{"a":"x\ny"}]',
]


@pytest.mark.parametrize("column", ["output_json", "result"])
def test_texts_beyond_the_limit_read_the_same(spark, column, monkeypatch):
    rows = [("t", f"s{i}", "completed", s if column == "output_json" else "", s if column == "result" else "") for i, s in enumerate(SAMPLES)]
    stages = stages_df(spark, *rows)

    def read():
        parsed = findings.parse_findings(stages)
        shown = parsed.select("name", "state", F.transform("items", lambda x: F.to_json(x)).alias("items"), "raw_text")
        best = stages.select("name", jsontext.valid_json(column).alias("ok"), jsontext.extract_json_best(column).alias("best"))
        return sorted(map(tuple, shown.collect())), sorted(map(tuple, best.collect()))

    usual = read()
    monkeypatch.setattr(jsontext, "VARIANT_LIMIT_BYTES", 64)  # every text counts as too long for one variant
    monkeypatch.setattr(jsontext, "has_long_element", lambda text: F.lit(False))
    assert read() == usual


def test_a_document_over_the_limit_is_whole(spark):
    """150 MB in one array: all findings, in every roll-up."""
    n, pad = 3000, "x" * 50_000
    item = F.concat(F.lit('{"severity":"high","type":"RCE","description":"'), F.col("id").cast("string"), F.lit(pad + '"}'))
    text = spark.range(n).select(item.alias("item")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("output_json"))
    stages = text.select(
        F.lit("s").alias("stage_id"), F.lit("t").alias("task_id"), F.lit("rce").alias("name"), F.lit("completed").alias("status"),
        F.lit("").alias("result"), "output_json", F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"),
    )
    assert stages.select(F.octet_length("output_json")).first()[0] > jsontext.VARIANT_LIMIT_BYTES
    found = findings.stage_findings(stages)
    assert found.agg(F.count("*"), F.count_distinct("description")).first()[:] == (n, n)
    assert rollup.task_list(tasks_df(spark, ("t", "completed", ROUTES, "")), stages).first().finding_count == n


def test_groups_of_a_large_document(spark):
    """200,000 elements, a third of them repeats."""
    n = 200_000
    items = spark.range(1).select(
        F.lit("s").alias("stage_id"), F.lit("rce").alias("stage"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.parse_json(F.concat(
            F.lit('{"type":"RCE","location":{"file":"f'), F.when(i % 3 == 0, i % 999).otherwise(i).cast("string"),
            F.lit('"},"n":'), i.cast("string"), F.lit("}")))).alias("items"),
    )
    begin = time.time()
    rows = algebra.signature_groups(items, ["stage_id"], algebra.item_signature)
    got = rows.agg(F.count("*"), F.sum(F.size("members")), F.max(F.size("members"))).first()
    kept = {i % 999 if i % 3 == 0 else i for i in range(n)}
    assert got[0] == len(kept) and got[1] == n and got[2] > 200
    first = rows.where("pos = 0").select(F.transform("members", lambda m: jsontext.text_at(m, "n")).alias("n")).first().n
    assert first == sorted(first, key=int) and first[:2] == ["0", "999"]
    assert time.time() - begin < 60
