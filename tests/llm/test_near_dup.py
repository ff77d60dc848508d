"""Near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from siftlake.llm import near_dup
from siftlake.llm.components import components
from tests.llm import brute


def groups(seed, hub_last):
    """Copies around texts with few and many edits, chains, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 100

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words)))
        at += 1

    for size in (5, 30, 80):
        base = [rng.choice(vocabulary) for _ in range(120)]
        if not hub_last:
            add(base)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(copy)
        if hub_last:  # the text that links the group has the largest id
            add(base)
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(12):  # each is linked with the next only
        add(chain)
        chain = chain[8:] + [rng.choice(vocabulary) for _ in range(8)]
    return rows + [
        (1, None), (2, ""), (3, " \n"), (4, "Same Few"), (5, "same\tfew"), (6, "few same"), (7, "solo " * 3000), (8, "SOLO solo " * 800),
    ]


@pytest.mark.parametrize("hub_last", [False, True])
def test_components_of_documents(spark, hub_last, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # several blocks in a bucket
    rows = groups(3, hub_last)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.near(rows).items()}
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in got.items() if v[2])


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    text = "a b c d e f g"
    rows = [(None, text), (9, text), (9, text), (4, text + " "), (None, None)]
    out = sorted(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, schema)).drop("_content").collect()), key=str)
    assert out == sorted(
        [(None, 3, None, True), (9, 3, 4, False), (9, 3, 4, False), (4, 3, 4, True), (None, 0, None, True)], key=str
    )
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_one_id_with_several_texts(spark):
    rows = groups(5, True)[:60]
    again = [(rows[0][0], t + " more") for _, t in rows[40:50]]
    df = spark.createDataFrame(rows + again, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(again)
    want = brute.near(rows)
    merged = {r.doc_id: r.component_id for r in got}
    assert all(merged[d] <= c for d, (_, c) in want.items())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600).astype(np.uint64)])
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert abs(same - 2400 / 3600) < 0.09
    # Coordinate k is coordinate 0 of the set moved along the circle: one permutation, shifted.
    assert len(set(near_dup.signature(a).tolist())) > near_dup.K // 4


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
