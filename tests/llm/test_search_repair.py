"""Conversation repair, licence scans and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siftlake.llm import conversation_repair, lexical_search, license_scan
from siftlake.llm.license_texts import TEMPLATES
from tests.llm import brute

GOOD = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest())
    return sorted(rows, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not signs else "duplicate" if (role, text) in seen else "cut" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by all states after each row; inserts as long as they improve."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", [])}

    def filled(best):
        best = dict(best)
        for _ in range(4):
            for state, (c, a, made) in list(best.items()):
                for x in "ua":
                    if (to := step[state].get(x)) is not None:
                        new = (c + 3, a + "I", [*made, NAMES[x] + ":"])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    for (_, _, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for state, (c, a, made) in filled(best).items():
            options = [(state, (c + 4, a + "D", made))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "cut" else 0
                for letter, name, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (to := step[state].get(name[:1])) is not None:
                        options.append((to, (c + cost + more, a + letter, [*made, f"{name}:{text}"])))
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    best = filled(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def everything(rows):
    """All edits with at most two inserts at a place, for three rows at most."""
    found = None
    inserts = ["", "u", "a", "ua", "au"]
    marks = faults(rows)
    choices = []
    for (_, _, role, _), fault in zip(rows, marks):
        own = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "cut" else 0
            own += [("K", role[:1], more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        choices.append(own)
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            roles = added[0] + "".join(e[1] + i for e, i in zip(edits, added[1:]))
            if GOOD.match(roles):
                audit = "I" * len(added[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(edits, added[1:]))
                cost = sum(e[2] for e in edits) + 3 * sum(map(len, added))
                found = min(found or (cost, audit), (cost, audit))
    return found


def repair_brute(all_rows, rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        own = in_order([r for r in rows if r[0] == conv])
        if not own:
            out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        f = Counter(faults(own))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(own)
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, f["blank"], f["duplicate"], f["cut"], illegal, cost, audit, digest)
    return out


def talk(rng, conv, n):
    texts = ["Yes.", "no", "So?", "", " \t", "Well!", "then ", "a. ", "é\x0b", "Long one. Ends."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    turns = [rng.choice([None, t, t, t, max(0, t - 1), t + 3]) for t in range(n)]
    return [(conv, t, rng.choice(roles), rng.choice([*texts, None])) for t in turns]


def test_lightest_is_the_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = in_order([(c, t, r or " ", x or " ") for c, t, r, x in talk(rng, 1, rng.randint(1, 3))])
        want = everything(rows)
        assert cheapest(rows)[:2] == want
        piece = conversation_repair._Piece(1, whole_start=True)
        seen = set()
        for (_, t, role, text), fault in zip(rows, faults(rows)):
            piece.add(t, role[:1], 1, fault == "blank", fault == "cut", fault == "duplicate")
            seen.add((role, text))
        row = piece.row(0, complete=True)
        ends = [(c, a) for c, a in zip(row["costs"], row["audits"]) if c is not None]
        assert ends == [want]


def test_repair(spark):
    rng = random.Random(6)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(1, 9))]
    rows += talk(rng, None, 40) + talk(rng, 500, 2500) + [(501, None, "user", "Hi.")] * 30
    rows += [(600 + k, 0, "user", "Hi.") for k in range(60)]  # some of these lose their only row
    schema = "conv_id long, turn long, role string, text string, audit string"
    df = spark.createDataFrame([(*r, "?") for r in rows], schema).repartition(5)
    got = conversation_repair.repair_report(df, conversation_repair.damage(df)).collect()
    want = repair_brute(rows, damaged(rows))
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("segment,tasks", [(3, 1), (1024, 4), (2, 5)])
def test_pieces_and_segments(segment, tasks, monkeypatch):
    """Conversations cut by tasks and segments have the plan of the whole."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    streams, want = [], {}
    for conv in range(40):
        rows = in_order([(c, t, r or " ", x or " ") for c, t, r, x in talk(rng, conv, rng.randint(1, 30))])
        f = faults(rows)
        streams += [
            (conv, 0, t, role[:1], 1, fault == "blank", fault == "cut", fault == "duplicate")
            for (_, t, role, _), fault in zip(rows, f)
        ]
        want[conv] = (*repair_brute(rows, rows)[conv][:6], cheapest(rows)[1])
    cuts = sorted(rng.sample(range(1, len(streams)), tasks - 1))
    names = [c.split()[0] for c in conversation_repair.PIECE.split(", ")]
    pieces = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(streams)])):
        own = [(r[0], part, *r[2:]) for r in streams[a:b]]
        pieces += [tuple(p[n] for n in names) for p in conversation_repair._pieces(iter(own))]
    got = {r["conv_id"]: (*(r[c] for c in conversation_repair.REPORT),) for r in conversation_repair._wholes(iter(pieces))}
    assert got == want


def test_segments_join():
    """A conversation cut anywhere has the derivation of the whole."""
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(2, 40)
        rows = [rng.choice([("s", False, 0), ("u", True, 0), ("u", False, 0), ("a", False, 0), ("", False, 2)]) for _ in range(n)]
        cut = rng.randint(1, n - 1)
        light = conversation_repair.lightest
        left, right = {0: light(rows[:cut], 0)}, {s: light(rows[cut:], s) for s in range(4)}
        assert conversation_repair.joined(left, right)[0] == light(rows, 0)


def test_repair_of_an_empty_table_and_real_outputs(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.repair_report(empty, empty).count() == 0
    rows = [(1, 0, "assistant", "So."), (1, 1, "user", "Hm."), (1, 2, "user", "Ah.")]
    df = spark.createDataFrame(rows, schema)
    plan = conversation_repair.repair_plan(df)
    assert plan.first()["audit"] == cheapest(rows)[1]
    made = conversation_repair.repaired_rows(df, plan).orderBy("place").collect()
    assert [f"{r['role']}:{r['text']}" for r in made] == cheapest(rows)[2]


# Licences


def license_brute(text, templates, phrases, least, gap, share):
    words = brute.bench_words(text)
    places, base = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.5 if base else 0.0
    for label, template in templates:
        t = brute.bench_words(template)
        matches = []  # (start, end, template end), not longer on either side
        longest = {}
        for i in range(len(words)):
            n = 0
            while any(t[j : j + n + 1] == words[i : i + n + 1] for j in range(len(t) - n)) and i + n < len(words):
                n += 1
            if n >= least and longest.get("end", -1) < i + n - 1:
                longest["end"] = i + n - 1
                matches.append((i, i + n - 1, [j + n - 1 for j in range(len(t) - n + 1) if t[j : j + n] == words[i : i + n]]))
        nodes = []
        for s, e, ends in matches:
            own = []
            for p in ends:
                value = e - s + 1
                for e2, p2, v2 in nodes:
                    if e2 < e and p2 < p and p - (e - s + 1) - p2 <= gap and s - e2 - 1 <= gap:
                        value = max(value, v2 + min(e - s + 1, e - e2, p - p2))
                own.append((e, p, value))
            nodes += own
        best = max([v for _, _, v in nodes], default=0)
        if best and best >= share * len(t):
            labels.add(label)
            score = max(score, best / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), score


def license_texts(rng, n):
    signs = ["the", "of", "license", "mit", "apache", "public", "general", "é", "x1", "software"]
    out = [None, "", "...", "Mit License mit LICENSE", "General Public-License general public license"]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(signs, k=rng.randint(0, 8))
            t = rng.choice(TEMPLATES)[1].split()
            at = rng.randint(0, len(t))
            piece = t[at : at + rng.randint(0, 60)] if rng.random() < 0.6 else list(t)
            words += [w for w in piece if rng.random() > 0.04]
        out.append(rng.choice([" ", "\n"]).join(words))
    return out


def test_licenses(spark):
    rng = random.Random(8)
    texts = license_texts(rng, 120)
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate([*texts, texts[6]])], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df, with_text=False).collect()}
    for i, t in enumerate([*texts, texts[6]]):
        r = got[i]
        want = license_brute(t, TEMPLATES, license_scan.PHRASES, 3, 6, 0.6)
        mine = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"])
        assert mine == want[:6], t
        assert abs(r["score"] - want[6]) < 1e-12
    assert sum(len(r["spans"]) for r in got.values()) > 50


def test_license_spans_repeat_and_stream():
    """Each of many copies is a span, and blocks of words don't show."""
    scanner = license_scan.Scanner(TEMPLATES, license_scan.PHRASES)
    notice = "Licensed under the Apache License, Version 2.0. "
    text = ("some words. " + notice * 2) * 30_000
    words, places, first, last, base, spans = scanner.scan(text.encode())
    assert (words, places, first, last, base) == (18 * 30_000, 60_000, 5, 18 * 29_999 + 13, {"apache"})
    short = [s for s in spans if s[0] == "apache" and s[5] == 1.0]
    assert len(short) == 60_000
    assert scanner.scan(("a b " * 300_000).encode())[0] == 600_000


def test_license_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan_licenses(empty).count() == 0


# Search


def search_brute(docs, items, top):
    counted = [Counter(brute.bench_words(t)) for _, t in docs]
    full = [c for c in counted if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    terms = defaultdict(set)
    for item, t in items:
        terms[item] |= set(brute.bench_words(t))
    out = set()
    for item, wanted in terms.items():
        found = []
        for (doc, _), c in zip(docs, counted):
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms if c else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out |= {(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:top])}
    return out


@pytest.mark.parametrize("block,bundle,broadcast", [(4000, 256, 16 << 20), (7, 3, 0)])
def test_search(spark, monkeypatch, block, bundle, broadcast):
    monkeypatch.setattr(lexical_search, "BUNDLE", bundle)
    monkeypatch.setattr(lexical_search, "BROADCAST", broadcast)
    rng = random.Random(block)
    vocabulary = [f"w{k}" for k in range(60)] + ["THE"] * 60 + ["Of"] * 40 + ["été"] * 9
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "-"]) for _ in range(n))
    docs = [(i, prose(rng.randint(0, 40))) for i in range(150)]
    docs += [(9, docs[9][1]), (None, docs[3][1]), (200, None), (201, ""), (202, "?"), (203, prose(3000)), (204, docs[4][1])]
    items = [(i, prose(rng.randint(0, 12))) for i in range(12)]
    items += [(3, prose(4)), (None, "w1 the"), (50, None), (51, "nothing-here"), items[2]]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(df, bench, block_docs=block).collect()]
    assert set(got) == search_brute(docs, items, 10)
    assert len(got) == len(set(got))


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical_search.search(some, items.limit(0)).count() == 0
