"""The pipeline and the registered queries against plain versions over the smallest tables."""

from __future__ import annotations

import hashlib

import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from siftlake.llm import oracle, pieces, queries
from siftlake.llm.common import table
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_twins(spark):
    con = connect(SF)
    for name, sql in oracle.ORACLE.items():
        result = compare(spark, con, name, queries.QUERIES[name], sql, SF)
        assert result.startswith("ok"), (name, result)


def test_query_digests(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = dict(zip((d for d, _ in rows), library.encode([t or "" for _, t in rows])))
    for r in queries.QUERIES["op4_pieces"](spark, SF).collect():
        own = [*ids[r.doc_id], 2]
        assert r.as_library and r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(own).encode()).hexdigest()
    for r in queries.QUERIES["op5_token_count"](spark, SF).collect():
        assert (r.n_tokens, r.over_limit) == (len(ids[r.doc_id]), len(ids[r.doc_id]) > 4096)
    for r in queries.QUERIES["op1_secret_layers"](spark, SF).collect():
        spans = r.spans.split(",") if r.spans else []
        if r.n_layers == 1:
            assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
            assert len(spans) == r.n_assign + r.n_access + r.n_hex


def brute_pipeline(docs, items):
    """docs: (doc_id, text, source). Returns (doc_id, text) after the first four stages."""
    judged = brute.quality(docs)
    rows = sorted((d, j[5]) for (d, _, _), j in zip(docs, judged) if j[4])
    left = []
    for (d, t), gone in zip(rows, brute.line_runs(rows)):
        if gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone))
        if not gone or brute.words(t):
            left.append((d, t))
    near = brute.near(left)
    left = [(d, t) for d, t in left if near[d][1] == d]
    return [x for x, (n, h, _) in zip(left, brute.decontamination(left, items)) if not (h > 0 and 20 * h >= n)]


def test_pipeline(spark):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = brute_pipeline(docs, items)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded", "as_library"]
    got = sorted((r.doc_id, r.text, r.n_chars, r["ids"], r.decoded, r.as_library) for r in out.collect())
    assert got == sorted((d, t, len(t), library.encode(t, add_eos=True), library.decode(library.encode(t)), True) for d, t in want)
    assert 0 < len(got) < len(docs)


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "w " * 9000, "en", None, 18000, 1)]
    rows += [(3 + i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1, 0) for i in range(4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert (len(out.columns) == len(docs.columns)) == (n < 4)
            out.collect()
