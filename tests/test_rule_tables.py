"""Rules as rows: formulas of grams, and the join of lines and rules on them."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import patterns
from siftlake.operators import rule_tables, scans

LINES = "task_id string, path string, line int, text string"
RULES = "rule_no long, pattern string, type string, subtype string, severity string, description string"


def grams_of(text):
    text = text.translate(patterns._FOLD)
    return {text[i : i + patterns.GRAM] for i in range(len(text) - patterns.GRAM + 1)}


def true_for(known, have):
    if known is True or isinstance(known, str):
        return known is True or known in have
    return (all if known[0] == "and" else any)(true_for(part, have) for part in known[1])


def test_formulas():
    assert patterns.formula("abcd") == ("and", ("abc", "bcd"))
    assert patterns.formula(r"\.(get|put)\(") == ("or", (("and", (".ge", "get", "et(")), ("and", (".pu", "put", "ut("))))
    assert patterns.cover(patterns.formula(r"(?i)secret\s*=")) == ["cre"]
    for nothing in ("ab", "a.b", "x*", "", "(abc)?", r"\d+", r"\p{L}abc", r"[a-z&&[b]]abc", "(", "(?iu)kelvin"):
        assert patterns.formula(nothing) is True, nothing
    # A stretch goes on over a border, a look around and an optional character.
    assert patterns.formula(r"ab\bcd") == ("and", ("abc", "bcd"))
    assert patterns.formula("ab(?=c)cd") == ("and", ("abc", "bcd"))
    assert patterns.formula("https?:") == ("or", (("and", ("htt", "ttp", "tp:")), ("and", ("htt", "ttp", "tps", "ps:"))))


atom = st.one_of(st.sampled_from(["a", "b", "C", "é", ".", "[ab]", "[^a]", r"\w", r"\b", "a?", "b*", "c+", "c{2}", "ab{0,3}"]))
pattern = st.recursive(
    atom,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=5).map("".join),
        st.lists(inner, min_size=1, max_size=3).map(lambda w: f"({'|'.join(w)})"),
        inner.map(lambda p: f"(?:{p})+"),
    ),
    max_leaves=10,
)


@settings(max_examples=1500, deadline=None)
@given(pattern, st.text("abcABCé x", max_size=16), st.booleans())
def test_a_match_makes_the_formula_true(wanted, text, fold):
    wanted = f"(?i){wanted}" if fold else wanted
    found = re.search(wanted, text, re.ASCII)
    if found is not None:
        known = patterns.formula(wanted)
        assert true_for(known, grams_of(text))
        chosen = patterns.cover(known)
        assert chosen is None or set(chosen) & grams_of(text)


def line_rows(spark):
    texts = [
        "eval($x); system ('ls')", "EVAL (1)", "mysqli_query(PDO::query(1))", "md5(sha1(x))", "medieval", "", None,
        "a" * 5000 + " exec(1) " + "eval(" * 50, "plain", "éval(évaluation)", "\U0001f600exec(\U0001f600", "id = 1234567",
    ]
    rows = [("t", "a.php", i, s) for i, s in enumerate(texts)] * 2
    return spark.createDataFrame(rows, LINES)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_join_equals_trying_every_rule(spark, broadcast):
    # Thousands of rules: most meet no line; some share grams, are equal, say nothing or are null.
    given = [p for p, *_ in dims.STATIC_RULES] + [r"\d{7}", "(?i)ev.l", "^a+", "eval", "eval", "", None, "val|exec", "éval"]
    given += [rf"word{i}x\(" for i in range(5000)]
    rules = spark.createDataFrame([(i, p, "T", "S", "LOW", "d") for i, p in enumerate(given)], RULES)
    rows = line_rows(spark)
    got = sorted((r.line, r.rule_no) for r in rule_tables.rule_hits(rows, rules, broadcast_grams=broadcast).collect())
    tried = rows.select("line", *[F.col("text").rlike(p).alias(f"r{i}") for i, p in enumerate(given[:-5000]) if p is not None])
    want = sorted((r["line"], int(c[1:])) for r in tried.collect() for c in tried.columns[1:] if r[c])
    assert got == want and len(want) > 60


def test_plan_has_no_cross_join_and_no_line_shuffle(spark):
    rules = spark.createDataFrame(rule_tables.static_rule_table(), RULES)
    hits = rule_tables.rule_hits(line_rows(spark), rules)
    plan = hits._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_equal_to_the_folded_scans(spark):
    files = spark.createDataFrame(
        [
            ("t", "a.php", "eval(1)\nx\nmd5 (2)\r\n"), ("t", "b.go", '"password": "hunter2x"\nsk-' + "a" * 30),
            ("t", "c.js", '"api_key": "your-key"\napp.get("/users", f)'), ("t", "d.txt", "eval(1)"), ("u", "e.py", ""),
            ("u", "f.py", 'r.POST("/x", y)\n-----BEGIN RSA PRIVATE KEY-----'), ("u", "g.py", None), ("u", "h.py", "eval(\0"),
        ],
        "task_id string, path string, content string",
    )
    for folded, table, rules, schema in (
        (scans.static_scan, rule_tables.static_scan_table, rule_tables.static_rule_table(), RULES),
        (scans.secret_scan, rule_tables.secret_scan_table, dims.SECRET_RULES, "rule string, pattern string, value_group int"),
        (scans.route_candidates, rule_tables.route_candidates_table, dims.ROUTE_RULES, "framework string, pattern string"),
    ):
        want = folded(files)
        got = table(files, spark.createDataFrame(rules, schema)).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert want.count()
        assert table(files.limit(0), spark.createDataFrame(rules, schema)).count() == 0
        assert table(files, spark.createDataFrame([], schema)).count() == 0
