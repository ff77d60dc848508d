"""The byte network and the host ranks."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from siftlake.llm import byte_cnn, host_rank
from siftlake.llm.common import table
from siftlake.llm.oracle import ORACLE


def test_gradients():
    network = byte_cnn.Network(seed=3)
    rng = np.random.default_rng(4)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))
    data = [byte_cnn._padded(rng.integers(97, 105, n).astype(np.uint8).tobytes()) for n in (0, 5, 300, 900)]
    y = np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        p = np.clip(network.scores([d.tobytes() for d in data]), 1e-12, 1 - 1e-12)
        network.__dict__.pop("_ready", None)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = network._gradients(data, y)
    for name in network.NAMES:
        values, g = getattr(network, name).reshape(-1), grads[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g), 5) if np.any(g) else []:
            old = values[k]
            values[k] = old + 1e-3
            up = loss()
            values[k] = old - 1e-3
            down = loss()
            values[k] = old
            assert abs((up - down) / 2e-3 - g[k]) < 2e-2 * max(0.05, abs(g[k])), name


def test_chunks_cover_every_place():
    for places in (1, 7, 255, 256, 257, 480, 481, 1000, 5000):
        starts = byte_cnn._chunk_starts(places)
        covered = {p for s in starts for p in range(s, min(s + byte_cnn.CHUNK, places))}
        assert covered == set(range(places)) and all(s < places for s in starts)


def test_long_text_in_parts():
    network = byte_cnn.Network()
    rng = np.random.default_rng(2)
    long = rng.integers(32, 120, 400_000).astype(np.uint8).tobytes()
    one = network.scores([long])[0]
    assert network.scores([b"", long, b"x"])[1] == pytest.approx(one)
    # The end of a long text counts: no prefix decides.
    pooled, _ = network._pooled(byte_cnn._padded(long), network._ready)
    other, _ = network._pooled(byte_cnn._padded(long[:-300] + b"#" * 300), network._ready)
    assert not np.array_equal(pooled[-1], other[-1])


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    out = byte_cnn.score_quality(docs.select("doc_id", "text"), labels, limit=1500)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = (good[:, None] > bad[None, :]).mean()
    assert len(rows) > 300 and auc > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.94


def test_scores_of_odd_rows(spark):
    rows = [(None, "abc"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (None, 1)], "doc_id long, quality int")
    out = byte_cnn.score_quality(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = byte_cnn.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert byte_cnn.score_quality(docs.limit(0), labels).count() == 0


def brute_host(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def brute_rule(host, path):
    best = None
    for verdict, text in host_rank.RULES:
        name, _, start = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(text) > len(best[1]):
                best = (verdict, text)
    return best


def brute_rank(hosts, links, seed):
    """Fixed point of score = 0.15 seed + 0.85 of what links bring, by many rounds."""
    total = defaultdict(int)
    for (a, _), n in links.items():
        total[a] += n
    score = {h: 0.15 * seed[h] for h in hosts}
    for _ in range(400):
        got = dict.fromkeys(hosts, 0.0)
        for (a, b), n in links.items():
            got[b] += score[a] * n / total[a]
        score = {h: 0.15 * seed[h] + 0.85 * got[h] for h in hosts}
    return score


def brute_verdicts(hosts, links, good, bad, block_at=0.5):
    trust = brute_rank(hosts, links, good)
    distrust = brute_rank(hosts, {(b, a): n for (a, b), n in links.items()}, bad)
    share = {}
    for h in hosts:
        against, for_it = max(distrust[h], bad[h]), max(trust[h], good[h])
        share[h] = round(against / (against + for_it), 6) if against else 0.0
    out = {}
    for h in hosts:
        own = [(b, n) for (a, b), n in links.items() if a == h]
        led = sum(n for b, n in own if share[b] >= block_at) / max(1, sum(n for _, n in own))
        out[h] = "block" if share[h] >= block_at and max(bad[h], led) >= block_at else "allow"
    return trust, distrust, out


def sql_rows(rows):
    """The rows of the SQL twin, by page."""
    pages = pd.DataFrame([r[:3] for r in rows], columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    found = con.execute(ORACLE["op10_host_rank"]).fetchall()
    return {r[0]: (*r[1:5], pytest.approx(r[5], abs=1e-8), pytest.approx(r[6], abs=1e-8)) for r in found}


def test_filter_pages(spark):
    rng = random.Random(5)
    names = ["a.com", "b.example.com", "www.example.com", "c.net", "D.NET", "e.org", "f.org", "g.org", "com", "xcom", "h.org:80"]
    urls = [None, "", "no scheme", "x://", "://e.org/a", "http://C.net?x=/es/", "http://c.net#/es/", "https://c.net/es/?u=http://z.com/"]
    urls += [f"http://{rng.choice(names)}{rng.choice(['', '/', '/en/1', '/es/2', '/fr/3', '/EN/1', '/en'])}" for _ in range(120)]
    rows = []
    for i, u in enumerate([*urls, urls[20]]):
        hrefs = [rng.choice(["/local", "//", *(f"https://{n}/x" for n in names), f"//{rng.choice(names)}?q", "mailto:x@y.com"]) for _ in range(rng.randint(0, 4))]
        page = "".join(f"<a class='k' href={rng.choice(['', chr(34)])}{h}{' ' if i % 2 else chr(34)}>t</a>" for h in hrefs)
        rows.append((i, u, page if i % 9 else None))
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in host_rank.filter_pages(df).collect()}
    assert len(got) == len(rows)
    links = Counter()
    import re

    for i, u, page in rows:
        src = brute_host(u)[0]
        for to in re.findall(host_rank.LINK, page or ""):
            to = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in to)
            if src and to != src:
                links[src, to] += 1
    assert links
    pages, allowed, blocked = Counter(), Counter(), Counter()
    for _, u, _ in rows:
        host, path = brute_host(u)
        rule = brute_rule(host, path)
        pages[host] += 1
        allowed[host] += bool(rule) and rule[0] == "allow"
        blocked[host] += bool(rule) and rule[0] == "block"
    hosts = {*pages, *(b for _, b in links)}
    trust, distrust, verdicts = brute_verdicts(
        hosts, links, {h: allowed[h] / max(1, pages[h]) for h in hosts}, {h: blocked[h] / max(1, pages[h]) for h in hosts}
    )
    # Links in circles: all but a millionth of what the seeds give is passed on.
    for i, u, _ in rows:
        host, path = brute_host(u)
        rule = brute_rule(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.trust == pytest.approx(trust[host], abs=1e-6)
        assert r.distrust == pytest.approx(distrust[host], abs=1e-6)
        assert r.verdict == (rule[0] if rule else verdicts[host])
    assert {i: (r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for i, r in got.items()} == sql_rows(rows)


def test_distrust_follows_links_back(spark):
    rows = [(i, f"http://farm{i}.org/", "<a href='http://bad.net/x'>x</a>") for i in range(2)]
    rows += [(10 + i, "http://bad.net/es/", "<a href=http://good.org/>g</a>") for i in range(3)] + [(20, "http://good.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in host_rank.filter_pages(df).collect()}
    assert got[0].verdict == got[1].verdict == "block" and got[20].verdict == "allow" and got[0].rule is None
    bare = host_rank.filter_pages(df.drop("html"))
    assert {r.page_id: r.verdict for r in bare.collect()} == {0: "allow", 1: "allow", 20: "allow", 10: "block", 11: "block", 12: "block"}
    assert host_rank.filter_pages(df.limit(0)).count() == 0


def test_distrust_blocks_at_the_production_threshold(spark):
    to = lambda *hosts: "".join(f"<a href='http://{h}/x'>x</a>" for h in hosts)
    rows = [(i, f"http://farm{i}.org/", to("bad.net")) for i in range(9)]
    rows += [(9, "http://far.org/", to("farm1.org", "farm2.org")), (10, "http://mixed.org/", to("bad.net", "good.org", "other.org"))]
    rows += [(20 + i, "http://bad.net/es/", to("good.org")) for i in range(9)] + [(30, "http://bad.net/", None), (31, "http://good.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in host_rank.filter_pages(df).collect() if r.rule is None}
    assert {k for k, v in got.items() if v == "block"} == {*range(9), 9, 30}
    # The twin says the same on links, and a farm of any size stays blocked.
    assert {i: r[3] for i, r in sql_rows(rows).items() if r[2] is None} == got
    ring = [(i, f"http://ring{i}.org/", to("bad.net", f"ring{(i + 1) % 40}.org")) for i in range(40)] + [(90, "http://bad.net/es/", None)]
    small = spark.createDataFrame(ring, "page_id long, url string, html string")
    assert {r.verdict for r in host_rank.filter_pages(small).collect()} == {"block"}


def test_every_byte_counts():
    network = byte_cnn.Network()
    for text in (b"An odd text of some length, and no more than that", b"12345678", b"a" * 700 + b"bc"):
        pairs = network._pairs()
        pooled, _ = network._pooled(byte_cnn._padded(text), pairs)
        # A plain forward pass: every filter at every byte, maxima over each chunk.
        data = byte_cnn._padded(text)
        at = np.array([sum(network.filters[j][data[p + j]] for j in range(byte_cnn.WIDTH)) for p in range(len(data) - 7)])
        want = [at[s : s + byte_cnn.CHUNK].max(axis=0) for s in byte_cnn._chunk_starts(len(at))]
        assert np.allclose(pooled, np.array(want) + network.bias, atol=1e-4)
        for k in (0, len(text) - 1):  # some other byte there gives another maximum
            others = (network._pooled(byte_cnn._padded(text[:k] + bytes([c]) + text[k + 1 :]), pairs)[0] for c in range(256))
            assert any(not np.array_equal(o, pooled) for o in others)
