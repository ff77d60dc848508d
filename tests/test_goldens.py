"""Hand-written inputs with known answers."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from siftlake import schemas
from siftlake.functions import jsontext, labels, paths, text
from siftlake.operators import algebra, findings, lines, report, rollup, scans, transcript
from siftlake.operators.running import running
from siftlake.session import work_folder
from siftlake.sources import results, tables

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
ROUTES = '[{"method":"GET","path":"/a"},{"method":"POST","path":"/b"}]'


def tasks_df(spark, *rows):
    full = [(i, i, "", s, T0 + dt.timedelta(hours=n), r, o, []) for n, (i, s, o, r) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TASKS)


def stages_df(spark, *rows):
    full = [
        (f"s{n}", task, name, status, result, output, [], None, T0 + dt.timedelta(minutes=n), T0)
        for n, (task, name, status, output, result) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.STAGES)


def audit(spark):
    tasks = tasks_df(
        spark,
        ("task-1", "completed", ROUTES, ""),
        ("task-2", "running", "{}", 'note\n```json\n[{"method":"GET","path":"/c"}]\n```'),
    )
    stages = stages_df(
        spark,
        ("task-1", "rce", "completed", '[{"severity":"critical","type":"RCE"}]', ""),
        ("task-1", "auth", "completed", "[]", ""),
        ("task-2", "injection", "completed", "{}", "raw note"),
        ("task-2", "xss", "running", "[]", ""),
    )
    return tasks, stages


def test_dashboard(spark):
    tasks, stages = audit(spark)
    assert tuple(rollup.dashboard_stats(tasks, stages).first()) == (2, 3, 3, 1)
    coverage = {r.stage: r.n for r in rollup.stage_coverage(stages).collect()}
    assert (coverage["rce"], coverage["auth"], coverage["injection"], coverage["xss"]) == (1, 1, 1, 0)
    rows = rollup.stage_rows(stages)
    assert [(r.severity, r.n) for r in rollup.severity_breakdown(rows).collect()] == [("CRITICAL", 1)]


def test_task_list(spark):
    tasks = tasks_df(spark, ("a", "completed", ROUTES, ""), ("b", "completed", "{}", ""))
    stages = stages_df(
        spark,
        ("a", "xss", "completed", '[{"severity":"medium"},{"severity":"high"}]', ""),
        ("a", "logic", "completed", "[]", ""),
        ("b", "config", "completed", "{}", "only prose"),
    )
    got = {r.task_id: r for r in rollup.task_list(tasks, stages).collect()}
    assert (got["a"].route_count, got["a"].finding_count, got["a"].completed_stage_count) == (2, 2, 2)
    assert got["a"].highest_severity == "HIGH" and got["a"].total_stage_count == 9
    assert (got["b"].finding_count, got["b"].highest_severity) == (0, "UNKNOWN")


def test_json_recovery(spark):
    cases = {
        'before\n```json\n[{"a":1}]\n```\nafter': 1,
        'routes: [{"a":1}].': 1,
        "[1] x": None,
        "[1]],[2]": None,
        '[{"a":1}, null]': 2,
        '[{"a":1}, 3]': None,
        "[]": 0,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    out = df.select("t", jsontext.decode_array(jsontext.extract_json_block("t")).alias("i")).select(
        "t", F.when(F.col("i").isNotNull(), F.size("i")).alias("n")
    )
    assert {r.t: r.n for r in out.collect()} == cases
    best = {
        'see [link] then [{"a":1}] end': '[{"a":1}]',
        '```json\n[{"x":1}]\n``` and ```json\n[{"y":2}]\n```': '[{"y":2}]',
        "no list": "no list",
        'first [bad] {"k": 1} tail': '{"k": 1}',
    }
    df = spark.createDataFrame([(k,) for k in best], "t string")
    got = df.select("t", jsontext.extract_json_best("t").alias("b")).collect()
    assert {r.t: r.b for r in got} == best


def test_report(spark):
    finding = {
        "type": "RCE", "severity": "critical", "location": {"file": "a.go", "line": 7},
        "trigger": {"method": "GET", "path": "/run", "parameter": "cmd"}, "execution_logic": "flow",
        "vulnerable_code": "exec(x)", "impact": "full", "extra_note": "left over",
    }
    tasks = tasks_df(spark, ("t", "completed", ROUTES, ""))
    stages = stages_df(
        spark,
        ("t", "rce", "completed", json.dumps([finding]), ""),
        ("t", "xss", "running", "[]", ""),
        ("t", "auth", "completed", "[]", ""),
        ("t", "logic", "completed", "{}", "prose result"),
    )
    docs = report.report_documents(stages)
    got = {r.stage: r for r in report.report_stages(docs).collect()}
    assert set(got) == {"rce", "auth", "logic"}
    assert got["logic"].raw_only and got["logic"].raw_text == "prose result" and got["auth"].zero_findings
    over = report.report_overview(tasks, docs).first()
    assert (over.total_findings, over.clean_stage_count, over.route_count, over.unique_interfaces) == (1, 1, 2, 2)
    shown = report.report_findings(docs).first()
    assert (shown.anchor, shown.location, shown.trigger, shown.trigger_parameter) == ("rce-1", "a.go:7", "GET /run", "cmd")
    fields = report.report_fields(docs).orderBy("section", "ordinal", "key").collect()
    assert [f.key for f in fields] == ["execution_logic", "vulnerable_code", "impact", "extra_note"]
    assert fields[-1].label == "Extra Note"


def files_df(spark, **contents):
    return spark.createDataFrame([("t", p, c) for p, c in contents.items()], schemas.FILES)


def test_release_scope_and_secrets(spark):
    names = ["main.go", "data/config.example.json", "data/config.json", "frontend/node_modules/app.js",
             "frontend/.cache/tmp.txt", "release/out.zip"]
    files = files_df(spark, **{n: "x" for n in names})
    assert {r.path for r in scans.release_scope(files).collect()} == set(names[:2])
    entries = files.withColumn("is_dir", F.lit(False))
    assert {r.path for r in scans.unexpected_entries(entries).collect()} == set(names[2:])
    secret = '{\n "auth_key": "real",\n "password": "hunter2",\n "api_key": "sk-' + "a" * 24 + '"\n}\n'
    safe = '{"api_key": "replace-with-api-key", "password": ""}'
    files = files_df(spark, **{"unsafe.json": secret, "example.json": safe, "nul.json": "\0" + secret})
    got = {(r.path, r.rule) for r in scans.secret_scan(files).collect()}
    rules = ["config_auth_key", "config_password", "config_api_key", "openai_api_key"]
    assert got == {("unsafe.json", r) for r in rules}


def test_static_scan(spark):
    long_line = "eval(" + "x" * 600
    files = files_df(
        spark,
        **{"a.php": f"<?php\n  eval($x);\n{long_line}\nmd5($y); SYSTEM (1)\n", "b.txt": "eval(1)",
           "vendor/c.php": "eval(1)", ".git/d.php": "eval(1)", "src/e.go": "ok"},
    )
    got = sorted((r.path, r.line, r.subtype) for r in scans.static_scan(files).collect())
    assert got == [
        ("a.php", 2, "Command Injection"),
        ("a.php", 3, "Command Injection"),
        ("a.php", 4, "Command Injection"),
        ("a.php", 4, "Weak Cryptography"),
    ]


def test_ignored_directories(spark):
    files = files_df(spark, **{"project/ignored.go": "needle", "projects/ignored.go": "needle", "src/keep.go": "needle é"})
    assert [r.path for r in lines.grep_lines(files, "needle").collect()] == ["src/keep.go"]
    assert [r.path for r in lines.search_paths(files, "*.go").collect()] == ["src/keep.go"]
    assert [r.name for r in lines.list_children(files).collect()] == ["src"]
    assert {r.path for r in lines.tree(files).collect()} == {".", "src", "src/keep.go"}
    asked = spark.createDataFrame([("project/ignored.go",), ("src/keep.go",), ("../x",), ("a/../../t2/x",)], "p string")
    got = asked.select("p", paths.resolve_status(F.lit("/srv/t"), "p").alias("s")).collect()
    assert [r.s for r in got] == ["ignored", "ok", "outside", "outside"]


def test_labels(spark):
    df = spark.createDataFrame([("context deadline exceeded",), ("status code: 400",), ("status code: 429",)], "e string")
    assert [r[0] for r in df.select(labels.is_retryable("e")).collect()] == [True, False, True]
    cut = spark.createDataFrame([("aé" * 5,)], "s string").select(text.cut_bytes("s", 4, "!").alias("c")).first().c
    assert cut.startswith("aéa") and cut.endswith("!")
    assert text.glob_to_regex("**/a*.[ch]") == r"^a[^/]*\.[ch]$"


def finding_docs(spark, *items):
    rows = [("d", "rce", json.dumps(i)) for i in items]
    docs = spark.createDataFrame(rows, "stage_id string, stage string, j string")
    return docs.select("stage_id", "stage", jsontext.decode_array("j").alias("items"))


def as_dicts(df, *order):
    rows = df.orderBy(*order).select(F.to_json("f").alias("j")).collect()
    return [json.loads(r.j) for r in rows]


A = {"subtype": "x", "location": {"file": "A.go", "line": 3}, "impact": "old", "note": " ", "severity": "odd"}


def test_dedupe_and_normalise(spark):
    later = {**A, "location": {"file": "a.GO ", "line": "3"}, "impact": "", "note": "new", "more": [1]}
    docs = finding_docs(spark, [A, {"description": "Same"}, later, {"description": "same "}])
    got = as_dicts(algebra.initial_findings(docs, ["stage_id"]), "pos")
    assert len(got) == 2
    first = got[0]
    assert (first["type"], first["severity"], first["origin"]) == ("RCE", "HIGH", "initial")
    assert (first["impact"], first["note"], first["more"]) == ("old", "new", [1])
    assert first["verification_status"] == "unreviewed"


def test_gap_check_and_revalidation(spark):
    keys = ["stage_id"]
    stored = finding_docs(spark, [{**A, "verification_status": "confirmed"}]).withColumnRenamed("items", "stored_items")
    answer = finding_docs(spark, [{**A, "impact": "richer"}, {**A, "subtype": "fresh"}, {**A, "subtype": "fresh", "n": 1}])
    groups = algebra.run_groups(stored.join(answer.withColumnRenamed("items", "answer_items"), ["stage_id", "stage"]), keys)
    merged = algebra.gap_check_merge(groups, keys)
    got = as_dicts(merged, "run", "pos")
    assert [g["impact"] for g in got] == ["old", "old"] and got[1]["origin"] == "gap_check" and "n" not in got[1]
    assert algebra.gap_check_summary(merged, keys).first().added == 1
    richer = as_dicts(algebra.gap_check_merge(groups, keys, enrich=True), "run", "pos")
    assert [g["impact"] for g in richer] == ["richer", "old"] and richer[1]["n"] == 1
    reviewed = as_dicts(algebra.revalidation_merge(groups, keys), "pos")
    # A review without a status overwrites the stored one.
    assert [(r["impact"], r["verification_status"]) for r in reviewed] == [("richer", "unreviewed")]


def test_route_runs(spark):
    stages = stages_df(spark, ("t", "init", "completed", ROUTES, ""), ("u", "init", "completed", "{}", "prose"))
    more = '[{"method":"get","path":"/a","description":"again"},{"method":"PUT","path":"/new"}]'
    rows = [("s0", "gap_check", more), ("s0", "initial", "no list"), ("s0", "revalidate", "[]"), ("s1", "gap_check", more)]
    runs = algebra.run_answers(stages, spark.createDataFrame(rows, "stage_id string, kind string, content string"))
    errors = {(r.stage_id, r.kind): r.error for r in runs.filter(F.col("error").isNotNull()).collect()}
    assert errors == {("s0", "revalidate"): "no_revalidation", ("s1", "gap_check"): "no_structured_result"}
    got = as_dicts(algebra.finalize_routes(runs).filter(F.col("kind") == "gap_check"), "pos")
    assert [(g["path"], g.get("description")) for g in got] == [("/a", "again"), ("/b", None), ("/new", None)]


def messages_df(spark, *rows):
    full = []
    for n, row in enumerate(rows):
        m = {"role": "user", "kind": "normal", "content": "", "calls": [], "answer": None, "tool": None, **row}
        calls = [(c, "grep_files", "{}") for c in m["calls"]]
        full.append(("s", n, m.get("id", f"m{n}"), None, m["role"], m["kind"], m["content"], calls, m["answer"],
                     m["tool"], None, None, T0))
    return spark.createDataFrame(full, schemas.MESSAGES)


def seqs(df):
    return [r.seq for r in df.orderBy("seq").collect()]


def test_tool_rounds(spark):
    call, answer = {"role": "assistant", "calls": ["a", "b"]}, {"role": "tool", "answer": "a"}
    m = messages_df(spark, {}, {"role": "tool", "answer": "zz"}, call, answer, {}, {"role": "assistant", "calls": ["a"]}, answer)
    assert seqs(transcript.sanitize_rounds(m)) == [0, 4, 5, 6]
    counts = transcript.sanitize_counts(m).first()
    assert (counts.dropped_tools, counts.dropped_rounds) == (1, 1)
    m = messages_df(spark, {}, {}, {"role": "assistant", "calls": ["a"]}, {}, answer, {}, {})
    split = transcript.tail_split(m, 3)
    assert seqs(split.filter("in_tail")) == [2, 3, 4, 5, 6]


def test_boundary_and_memory(spark):
    m = messages_df(spark, {"id": "old-a"}, {"id": "old-b"}, {"id": "bnd", "kind": "compact_boundary"}, {"id": "sum"})
    m = m.withColumn("boundary", F.when(F.col("id") == "bnd", F.expr(
        "named_struct('source', 'auto', 'pre_bytes', 1L, 'post_bytes', 1L, 'summarized_message_count', 0L, "
        "'head_id', 'old-a', 'anchor_id', 'old-a', 'tail_id', 'old-b')")))  # fmt: skip
    states = spark.createDataFrame(
        [("s", "bnd", "old-b", "notes"), ("t", None, None, " ")],
        "session string, active_boundary_id string, last_memory_message_id string, memory_text string",
    )
    prompts = spark.createDataFrame([("s", "do it")], "session string, prompt string")
    again = m.unionByName(m.filter("id = 'old-a'").selectExpr(*[
        {"content": "'do it' as content", "id": "'again' as id", "seq": "5L as seq"}.get(c, c) for c in m.columns]))
    view = transcript.chat_view(transcript.active_messages(again, states), prompts=prompts)
    assert [r.id for r in view.orderBy("seq").collect()] == ["root-prompt", "old-a", "old-b", "sum"]
    assert seqs(transcript.memory_tail(m, states)) == [2, 3]
    assert seqs(transcript.memory_tail(m, states.withColumn("memory_text", F.lit("")))) == []
    grown = transcript.memory_delta(m, states.withColumns({
        "consecutive_memory_failures": F.lit(1), "last_memory_failure_at": F.lit(T0)}), 0, 0, F.lit(T0), 60)
    assert [r.fires for r in grown.collect()] == [False]
    late = F.lit(T0 + dt.timedelta(seconds=61))
    grown = transcript.memory_delta(m, states.withColumns({
        "consecutive_memory_failures": F.lit(1), "last_memory_failure_at": F.lit(T0)}), 0, 0, late, 60)
    assert [r.fires for r in grown.collect()] == [True]


def test_microcompact(spark):
    call = {"role": "assistant", "calls": ["a"]}
    m = messages_df(
        spark, {}, call, {"role": "tool", "answer": "a", "tool": "read_file", "content": "x" * 200},
        call, {"role": "tool", "answer": "a", "tool": "grep_files", "content": "y" * 200},
    )
    got = transcript.microcompact(m, keep=1).collect()
    assert [(r.seq, r.artifact_id) for r in got] == [(2, "art-1")] and 'get_artifact("art-1")' in got[0].placeholder
    # Numbers go on from the session's highest, in its messages or in its state.
    owned = m.withColumn("artifact_id", F.when(F.col("seq") == 4, "art-6"))
    assert [r.artifact_id for r in transcript.microcompact(owned, keep=1).collect()] == ["art-7"]
    states = spark.createDataFrame([("s", 9)], "session string, next_artifact_id long")
    assert [r.artifact_id for r in transcript.microcompact(owned, keep=1, states=states).collect()] == ["art-10"]


def test_state_feeds_the_transcript(spark, tmp_path):
    folder = tmp_path / "t" / "rce"
    folder.mkdir(parents=True)
    (folder / "state.json").write_text(json.dumps(
        {"task_id": "t", "status": "paused", "active_boundary_id": "m3", "memory_text": "notes", "next_artifact_id": 4}))
    states = tables.read_states(spark, str(tmp_path))
    call = {"role": "assistant", "calls": ["a"]}
    answer = {"role": "tool", "answer": "a", "tool": "read_file", "content": "x" * 200}
    m = messages_df(spark, {}, call, answer, {"kind": "compact_boundary"}, call, answer, call, answer, {}).withColumn("session", F.lit("t/rce"))
    ends = "named_struct('source', 'auto', 'pre_bytes', 1L, 'post_bytes', 1L, 'summarized_message_count', 1L, 'head_id', 'm1', 'anchor_id', 'm1', 'tail_id', 'm2')"
    m = m.withColumn("boundary", F.when(F.col("id") == "m3", F.expr(ends)))
    active = transcript.active_messages(m, states)
    assert seqs(active) == [1, 2, 4, 5, 6, 7, 8]
    view = transcript.chat_view(active)
    cleared = transcript.microcompact(view, keep=1, states=states)
    assert sorted((r.seq, r.artifact_id) for r in cleared.collect()) == [(2, "art-5"), (5, "art-6")]
    shown = transcript.chat_view(active, cleared)
    got = transcript.compaction_boundary(shown, size=2).first()
    assert (got.source, got.summarized_message_count, got.head_id, got.anchor_id, got.tail_id) == ("auto", 4, "m6", "m7", "m8")
    assert got.post_bytes == got.kept_bytes and got.pre_bytes > got.post_bytes


def test_messages_are_read_twice(spark, tmp_path):
    """Once for the narrow table that rounds and windows are judged on, once for the result."""
    path = str(tmp_path / "messages")
    call, answer = {"role": "assistant", "calls": ["a"]}, {"role": "tool", "answer": "a"}
    messages_df(spark, {}, call, answer, {}, {}, call, answer).write.parquet(path)
    for run in (transcript.sanitize_rounds, transcript.tail_split, transcript.compression_window):
        out = run(spark.read.schema(schemas.MESSAGES).parquet(path))
        assert out._jdf.queryExecution().optimizedPlan().collectLeaves().mkString().count("artifact_id") == 1


def test_latest_resumable_stage(spark):
    rows = [("t", "init", "paused", T0), ("t", "auth", "running", T0 + dt.timedelta(minutes=2)),
            ("t", "xss", "failed", T0 + dt.timedelta(minutes=4)), ("t", "rce", "completed", T0 + dt.timedelta(hours=1))]
    states = spark.createDataFrame(rows, "task_id string, stage string, status string, updated_at timestamp")
    assert transcript.latest_resumable_stage(states).first().stage == "xss"


def test_delete_tasks(spark):
    tasks = tasks_df(spark, ("done", "completed", "", ""), ("busy", "running", "", ""))
    stages = stages_df(spark, ("done", "rce", "completed", "[]", ""), ("busy", "rce", "running", "[]", ""))
    ids = spark.createDataFrame([("done",), ("busy",), ("gone",)], "task_id string")
    left, left_stages, outcome = tables.delete_tasks(tasks, stages, ids)
    assert {r.task_id: r.outcome for r in outcome.collect()} == {"done": "deleted", "busy": "conflict", "gone": "not_found"}
    assert [r.task_id for r in left.collect()] == ["busy"] == [r.task_id for r in left_stages.collect()]


def test_running_matches_a_loop(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else "cold", s, rng.randint(0, 5)) for s in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "k string, seq long, x int").repartition(5)
    out = running(df, ["k"], "seq", sums={"s": F.col("x")}, lasts={"last_big": F.when(F.col("x") > 3, F.col("seq"))},
                  totals={"n": F.lit(1)}, parts=7)
    got = {(r.k, r.seq): (r.s, r.last_big, r.n) for r in out.collect()}
    sums, big = {}, {}
    for k, seq, x in rows:
        sums[k] = sums.get(k, 0) + x
        big[k] = seq if x > 3 else big.get(k)
        assert got[k, seq] == (sums[k], big[k], sum(1 for r in rows if r[0] == k))


def test_corpus_and_documents(spark, tmp_path):
    for name, body in {"t1/src/a.go": "line\n", "t1/b.md": "x", "t2/c.php": "eval(1)"}.items():
        path = tmp_path / "projects-root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    files = tables.read_corpus(spark, str(tmp_path / "projects-root"))
    assert {(r.task_id, r.path, r.content) for r in files.collect()} == {
        ("t1", "src/a.go", "line\n"), ("t1", "b.md", "x"), ("t2", "c.php", "eval(1)"),
    }
    assert tables.read_corpus(spark, str(tmp_path / "projects-root"), "*.php").count() == 1
    quota = {r.task_id: r.reason for r in tables.corpus_quota(files.drop("bytes"), 6).collect()}
    assert quota == {"t1": "ok", "t2": "too_large"}
    items = spark.range(25).select(F.lit("t").alias("task_id"), F.lit("rce").alias("stage"), F.col("id").alias("pos"),
                                   F.format_string('{"n":%d}', "id").alias("item"))
    parts = tables.stage_documents(items, ["task_id", "stage"], part_rows=10)
    path = work_folder(spark, "test-results")
    results.write_stage_result(parts, path)
    back = results.read_stage_results(spark, path).orderBy("part").collect()
    assert [r.n for r in back] == [10, 10, 5]
    assert [x["n"] for r in back for x in json.loads(r.output_json)] == list(range(25))


def test_read_states(spark, tmp_path):
    good = tmp_path / "t1" / "rce" / "state.json"
    good.parent.mkdir(parents=True)
    good.write_text(json.dumps({"task_id": "t1", "status": "paused", "updated_at": "2024-01-01T00:00:00Z"}))
    bad = tmp_path / "t1" / "xss" / "state.json"
    bad.parent.mkdir(parents=True)
    bad.write_text("{broken")
    assert [(r.stage, r.status) for r in tables.read_states(spark, str(tmp_path)).collect()] == [("rce", "paused")]


def test_schema_check(spark):
    item = {"type": "XSS", "subtype": "Stored XSS"}
    stages = stages_df(spark, ("t", "xss", "completed", json.dumps([item]), ""))
    got = {(r.field, r.rule) for r in findings.schema_check(findings.stage_findings(stages)).collect()}
    assert got == {("storage_point", "required")}


def test_no_line_or_document_is_lost(spark, monkeypatch):
    long_line = "x" * (3 << 20)
    secret = '"password": "hunter2"'
    files = files_df(spark, **{"a.json": f"{long_line}\n{secret}\n", "b.php": f"{long_line} eval(1)\nmd5(2)", "c.go": "needle\n" * 300})
    assert [(r.path, r.line) for r in scans.secret_scan(files).collect()] == [("a.json", 2)]
    assert [r.passes for r in scans.secret_gate(files).collect()] == [False]
    assert sorted((r.path, r.line) for r in scans.static_scan(files).collect()) == [("b.php", 1), ("b.php", 2)]
    assert lines.grep_lines(files, "needle").count() == 300
    assert lines.grep_lines(files, "needle", max_results=5, offset=2).count() == 5
    asked = spark.createDataFrame([(1, "t", "c.go", 0, 0), (2, "t", "c.go", 299, 0), (3, "t", "no", 1, 2), (4, "t", "c.go", 5, 3)],
                                  "request_id int, task_id string, path string, start_line int, end_line int")
    got = {r.request_id: r.n for r in lines.read_range(asked, files).groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 300, 2: 2}
    plan = lines.read_range(asked, files)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # lines are made after the last shuffle
    monkeypatch.setattr(jsontext, "VARIANT_LIMIT_BYTES", 1000)
    stages = stages_df(spark, ("t", "rce", "completed", '[{"x":"' + "1" * 2000 + '"}]', ""), ("t", "auth", "completed", "{}", "prose"))
    assert {r.name: (r.state, r.raw_text) for r in findings.parse_findings(stages).collect()} == {
        "rce": ("array", None), "auth": ("raw", "prose"),
    }
    long = stages.select("name", jsontext.has_long_element(F.col("output_json")).alias("long"))
    assert {r.name: r.long for r in long.collect()} == {"rce": True, "auth": False}
    shown = {r.stage: (r.raw_only, r.zero_findings) for r in report.report_stages(report.report_documents(stages)).collect()}
    assert shown == {"rce": (False, False), "auth": (True, False)}


def test_large_stage_is_one_document(spark):
    items = spark.range(6000).select(F.lit("t").alias("task_id"), F.lit("rce").alias("name"), F.col("id").alias("pos"),
                                     F.format_string('{"severity":"low","description":"%d"}', "id").alias("item"))
    for documents in (
        tables.stage_documents(items, ["task_id", "name"]),
        tables.whole_documents(tables.stage_documents(items, ["task_id", "name"], part_rows=700), ["task_id", "name"]),
    ):
        stages = documents.select(
            F.lit("s").alias("stage_id"), "task_id", "name", F.lit("completed").alias("status"), F.lit("").alias("result"),
            "output_json", F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"),
        )
        tasks = tasks_df(spark, ("t", "completed", ROUTES, ""))
        assert rollup.task_list(tasks, stages).first().completed_stage_count == 1
        anchors = [r.anchor for r in report.report_findings(report.report_documents(stages)).select("anchor").collect()]
        assert len(anchors) == len(set(anchors)) == 6000


def test_static_scan_becomes_a_stage(spark):
    files = files_df(spark, **{"a.php": "eval(1)\nmd5(2)", "b.php": "ok"})
    items = scans.static_stage_items(scans.static_scan(files))
    document = tables.stage_documents(items, ["task_id", "stage"]).first()
    got = [(x["location"]["file"], x["location"]["line"], x["severity"]) for x in json.loads(document.output_json)]
    assert (document.n, got) == (2, [("a.php", "1", "CRITICAL"), ("a.php", "2", "MEDIUM")])


def test_running_on_sparse_sequences(spark):
    rows = [("hot" if s % 10 else "cold", s * 1_000_003, 1) for s in range(20_000)]
    df = spark.createDataFrame(rows, "k string, seq long, x int")
    out = running(df, ["k"], "seq", sums={"n": F.col("x")}, totals={"all": F.col("x")}, parts=8)
    sizes = {r.k: (r.top, r.all, r.n) for r in out.groupBy("k").agg(F.max("n").alias("top"), F.max("all").alias("all"), F.count("*").alias("n")).collect()}
    assert sizes == {"hot": (18_000, 18_000, 18_000), "cold": (2_000, 2_000, 2_000)}


def test_actions_for_stages_that_have_not_run(spark):
    tasks, stages = audit(spark)
    got = {(r.task_id, r.stage): r for r in findings.stage_actions(tasks, stages).collect()}
    assert len(got) == 20
    assert got["task-1", "xss"].can_run and got["task-1", "xss"].stage_id is None and not got["task-1", "xss"].can_gap_check
    assert got["task-1", "init"].can_gap_check and not got["task-1", "init"].can_revalidate
    assert got["task-1", "rce"].can_revalidate and not got["task-1", "auth"].can_revalidate
    assert not got["task-2", "init"].can_run
