"""Decontamination, pieces, token counts, secrets and page text."""

from __future__ import annotations

import base64
import bz2
import gzip
import random
import re
import time
import urllib.parse
import zlib

import pytest
import sentencepiece
import zstandard

from siftlake.llm import decontam, html_text, pieces, secret_layers, token_count
from tests.llm import brute


def texts(seed, n):
    rng = random.Random(seed)
    signs = list(" \n\t\r▁ab,.!é😀世\x00́ 　'\"-_()%$²") + ["the", "er", "   ", "<s>", "//", "====", "x"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("set_words", [decontam.SET_WORDS, 20])
def test_benchmark_hits(spark, set_words):
    rng = random.Random(2)
    vocabulary = ["Alpha", "bêta", "GAMMA", "d1", "x", "ÉTÉ"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "-"]) for _ in range(n))

    items = [(1, prose(14)), (2, prose(30)), (3, "one; two"), (4, None), (5, "..."), (None, prose(13)), (3, prose(20)), (6, "one; two")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, "ONE two three"), (5, prose(4000))]
    docs += [(10 + i, prose(rng.randint(1, 60)) + "\n" + (items[i % 4][1] or "") + " " + prose(9)) for i in range(20)]
    docs += [docs[6]]
    df = spark.createDataFrame([(*d, "?") for d in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.benchmark_hits(df, bench, set_words=set_words)
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out.collect())
    want = sorted(
        (d, n, h, tuple(i), h > 0 and 20 * h >= n) for (d, _), (n, h, i) in zip(docs, brute.decontamination(docs, items))
    )
    assert got == want
    again = decontam.decontaminate(df, bench, remove="spans")
    left = brute.decontamination([(r.doc_id, r.text) for r in again.collect()], [(3, "one; two")])
    assert sum(x[1] for x in left) == 0
    whole = decontam.decontaminate(df, bench)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(w[0] for w in want if not w[4])
    assert whole.columns == df.columns


def test_benchmark_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.benchmark_hits(docs, none).first().n_hit == 0
    assert decontam.benchmark_hits(docs.limit(0), none).count() == 0


def test_pieces_equal_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [(i, t) for i, t in enumerate([None, "", "a" * 3000, "=-" * 500, *texts(4, 3000)])] + [(1, ""), (None, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    out = pieces.encode_documents(df)
    got = sorted(((r.doc_id is None, r.doc_id, r["ids"], r.decoded, r.as_library) for r in out.collect()), key=str)
    ids = library.encode([t or "" for _, t in rows], add_eos=True)
    want = sorted(((d is None, d, i, library.decode(i), True) for (d, _), i in zip(rows, ids)), key=str)
    assert got == want
    back = pieces.decode_documents(out.select("doc_id", "ids"))
    assert sorted(str(r.decoded) for r in back.collect()) == sorted(w[3] for w in want)
    assert pieces.encode_documents(df.limit(0)).count() == 0


def test_pieces_decode_any_ids():
    agenda = pieces.Agenda(pieces.model_path())
    rng = random.Random(3)
    pool = [0, 1, 2, 3, 130, 198, 200, 227, 231, 243, 259, 264, 500, 1318, 28705]
    for _ in range(3000):
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        assert agenda.decode(ids) == agenda.library.decode(ids)


def test_library_check_finds_errors():
    agenda = pieces.Agenda(pieces.model_path())
    for piece in ("▁the", "er"):
        del agenda.rank[piece]
    some = [*texts(5, 300), "the other"]
    ids = [agenda.encode(t) for t in some]
    same = [a == b for a, b in zip(ids, agenda.library.encode(some))]
    assert agenda.as_library(some, ids) == same and not all(same)


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 8), (37, 5), (64, 64), (32_768, 256)])
def test_token_counts(spark, chunk, overlap):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(["", None, "a" * 500, "word " * 300, "x" * 3000 + " y", "é😀" * 400, "\n" * 700, " " * 900, "=-" * 900])]
    rows += [(20 + i, "".join(rng.choice(["the", " ", "ab", "\n", ".", "世", "x"]) for _ in range(rng.randint(0, 900)))) for i in range(30)]
    rows += [(3, rows[3][1]), (None, "null id " * 100), (3, "other text " * 50)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    out = token_count.count_tokens(df, chunk=chunk, overlap=overlap, limit=400)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=str)
    n = [len(i) for i in library.encode([t or "" for _, t in rows])]
    assert got == sorted(((d, len((t or "").encode()), k, k > 400) for (d, t), k in zip(rows, n)), key=str)
    assert token_count.count_tokens(df.limit(0)).count() == 0


BASE = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
]


def test_secret_base(spark):
    rng = random.Random(8)
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", "=", ": ", "\"", "'", " ", "abc", "abcdef1", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567", "é", "\n", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(600)] + [(1, None), (2, "")]
    rows += [(3, rows[5][1]), (None, "token=abcdefg"), (4, "x " * 50_000 + "secret: 'value.1'")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    out = secret_layers.find_secrets(df).collect()
    want = []
    for d, t in rows:
        spans = sorted(
            (m.start(), k, m.end()) for k, (rx, g, least) in enumerate(BASE) for m in rx.finditer(t or "") if len(m[g]) >= least
        )
        want.append((d, [(("assign", "access", "hex")[k], s, e) for s, k, e in spans]))
    got = [(r.doc_id, [tuple(b) for b in r.base]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in out:
        assert {tuple(b) for b in r.base} <= {tuple(b) for b in r.spans}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.kind == k for b in r.base) for k in ("assign", "access", "hex"))


PLAIN = "x password=hunter2abc y"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda t: urllib.parse.quote(t),
        lambda t: urllib.parse.quote(urllib.parse.quote(urllib.parse.quote(t, safe=""), safe=""), safe=""),
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
        lambda t: base64.b64encode(base64.b64encode(t.encode())).decode(),
        lambda t: base64.b64encode(gzip.compress(base64.b64encode(zlib.compress(t.encode())))).decode(),
        lambda t: base64.b64encode(bz2.compress((t * 9).encode())).decode(),
        lambda t: base64.encodebytes((("lorem ipsum " * 20) + t).encode()).decode(),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
        lambda t: "".join(f"&#{ord(c)};" for c in t),
        lambda t: "".join(f"%{b:02X}" for b in zlib.compress(t.encode())),
        lambda t: urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in base64.b64encode(t.encode()).decode()), safe=""),
    ],
)
def test_secret_layers(wrap):
    text = "pré é " + wrap(PLAIN) + " post"
    base, spans, layers, refused = secret_layers.scan(text)
    added = spans - set(base)
    assert added and layers > 1 and not refused
    for start, kind, end in added:
        assert kind == 0 and text[:start].startswith("pré é ") and end <= len(text) - len(" post")


B64 = base64.b64encode(PLAIN.encode()).decode()


@pytest.mark.parametrize(
    "text",
    [
        *(base64.b64encode(f"{sign}{PLAIN}".encode()).decode() for sign in "\ufeff\xa0\u3000\xad\u200b\f\x1b\0"),
        base64.b64encode(b"caf\xe9 \xff" + PLAIN.encode()).decode(),
        *(base64.b64encode(PLAIN.encode(kind)).decode() for kind in ("utf-16", "utf-16-le", "utf-16-be")),
        base64.b64encode(b"\x01" + PLAIN.encode("utf-16-le")).decode(),
        f"https://h.example/api/v1/{B64}",
        *(f"https://h.example/{'a' * k}/{base64.b64encode(B64.encode()).decode()}/x" for k in range(4)),
        *(f"{'x+y/z-' * 2}{'a' * k}+{B64}" for k in range(4)),
        *(f"{'ab+cd' * 9}{'a' * k}+{base64.b64encode(B64.encode()).decode()}" for k in range(4)),
        *("/".join(base64.b64encode((w + B64).encode()).decode().rstrip("=") for w in ("", " x", ";")) + "b" * k for k in range(3)),
        f"https://h.example/api/v1/{base64.b64encode(gzip.compress(PLAIN.encode())).decode()}",
        "\n".join("    " + B64[k : k + 10] for k in range(0, len(B64), 10)),
        "\r\n".join("\t" + B64[k : k + 7] for k in range(0, len(B64), 7)),
    ],
)
def test_secret_base64_of_any_bytes_and_place(text):
    base, spans, _, _ = secret_layers.scan(f"pre: {text}\n. post")
    assert not base and {s[1] for s in spans} >= {0}


def test_secret_layers_take_linear_time():
    part = base64.b64encode(base64.b64encode(b"nothing to be seen here, and so on, " * 2)).decode().rstrip("=")
    text = "/".join([part] * 4000)
    begin = time.time()
    spans = secret_layers.scan(f"{text}/{base64.b64encode(B64.encode()).decode()}")[1]
    assert {s[1] for s in spans} == {0} and time.time() - begin < 20


def joined(pack):
    return pack(b"first member") + pack(b"\n" + PLAIN.encode())


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress, zstandard.compress])
def test_secret_later_members(pack):
    for layer in (base64.b64encode(joined(pack)).decode(), urllib.parse.quote(joined(pack)), urllib.parse.quote_plus(joined(pack))):
        _, spans, _, refused = secret_layers.scan(f"pre: {layer} post")
        assert {s[1] for s in spans} == {0} and not refused


def test_secret_long_lines_and_wrapped_runs(monkeypatch):
    monkeypatch.setattr(secret_layers, "PIECE", 1 << 12)
    monkeypatch.setattr(secret_layers, "LONGEST", 1 << 16)
    rng = random.Random(9)
    line = "".join(rng.choice("ghijklmn_") for _ in range(200_000))
    tail = PLAIN.replace("=", " " * 9000 + "=").replace("x ", "x.")
    _, spans, _, refused = secret_layers.scan(base64.b64encode(gzip.compress(f"{line}.{tail}".encode())).decode())
    assert {s[1] for s in spans} == {0} and refused  # a part of the line is counted, what follows is found
    inner = base64.encodebytes(gzip.compress(rng.randbytes(20_000) + b"\n" + PLAIN.encode())).decode()
    _, spans, _, refused = secret_layers.scan(base64.b64encode(gzip.compress(inner.encode())).decode())
    assert {s[1] for s in spans} == {0} and not refused


def test_secret_spans_are_exact():
    text = "a pass%77ord=%22abc%64efg%22 b"
    _, spans, _, _ = secret_layers.scan(text)
    assert [text[s:e] for s, _, e in sorted(spans)] == ["pass%77ord=%22abc%64efg"]


def test_secrets_of_an_empty_table(spark):
    assert secret_layers.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secret_cycles_end():
    text = "%25" * 2000 + "41"
    assert secret_layers.scan(text)[2] < 2003
    bomb = base64.b64encode(zlib.compress(b"line\n" * (3 << 20) + b"token=abcdefgh\n")).decode()
    _, spans, _, refused = secret_layers.scan(bomb)
    assert {(0, 0, len(bomb))} <= spans and not refused


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="sidebar-page">
<header><a href="/">Home of the site</a></header><nav><ul><li><a href=/a>The menu is of the site</a></ul></nav>
<div class="cookie-notice">We use cookies and it is for the good of this site, as you will see in the terms.</div>
%s<aside>It is the sidebar that has to be left out of the text of the page.</aside>
<section id="comments"><p>I think that this is the best of all the articles on the web.</p></section>
<form><label>Name of the user</label><input></form><footer>&copy; the owner of the site</footer></body>"""


def test_page_text():
    body = "<article><h1>Title&amp;</h1><p>It is&nbsp;the   first <b>of</b> the\nparagraphs.<br>More<p>Zzz.<script>x('</p>')</script></article>"
    assert html_text.main_text(PAGE % body)[0] == "Title&\nIt is the first of the paragraphs. More\nZzz."
    nested = "<main><p>One of the blocks is this.</p><div class='ad'>Buy it in the shop that is near to you.</div><!-- <p>no --><p>Two.</p></main>"
    assert html_text.main_text(PAGE % nested)[0] == "One of the blocks is this.\nTwo."
    prose = "This is the text that a reader of the page came for, and it is as long as it has to be for the rules of this test. " * 3
    plain = f"<div><h2>Short head</h2><p>{prose}</p><p>End.</p></div>"
    assert html_text.main_text(PAGE % plain)[0] == f"Short head\n{prose.strip()}\nEnd."


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'class="overflow-hidden"', 'class="hidden-print"', 'aria-hidden="false"', "hidden=until-found", 'data-x="display:none"'])
def test_page_shown_blocks_stay(attributes):
    text = "It is the first of the paragraphs."
    assert html_text.main_text(PAGE % f"<article {attributes}><p>{text}</p></article>")[0] == text
    assert html_text.main_text(PAGE % f"<article><div {attributes}>{text}</div></article>")[0] == text


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', "aria-hidden=true", 'style="color:red; Display : none"'])
def test_page_hidden_blocks_go(attributes):
    assert html_text.main_text(PAGE % f"<article><p>One of the blocks.</p><div {attributes}>It is not shown.</div></article>")[0] == "One of the blocks."


def test_page_links_and_languages():
    linked = "It is said in <a href=x>a long report of the year</a> as well."
    body = f"<article><p>One of the blocks is this.</p><p>{linked}</p><ul><li><a href=y>Read all of the reports</a></li></ul></article>"
    assert html_text.main_text(PAGE % body)[0] == "One of the blocks is this.\nIt is said in a long report of the year as well."
    russian = "Это текст страницы, ради которого читатель пришёл сюда, и он достаточно длинный для правил этой проверки. " * 3
    assert html_text.main_text(PAGE % f"<div><p>{russian}</p><p>{russian}</p></div>")[0] == f"{russian.strip()}\n{russian.strip()}"
    prose = "This is the text that a reader of the page came for, and it is as long as it has to be for the rules of this test. " * 3
    terse = "Contributors grant recipients worldwide, royalty-free patent licenses covering essential claims; downstream recipients automatically receive licenses."
    assert html_text.main_text(PAGE % f"<div><p>{prose}</p><p>{terse}</p><p>{prose}</p></div>")[0].split("\n")[1] == terse


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<article><p>It is the end <b", "<script>x", "<!--", "</p></div>", "<a href='", "&#0;&#xD800;&bogus;"])
def test_page_odd(page):
    text, n = html_text.main_text(page)
    assert isinstance(text, str) and (n > 0) == bool(text)


def test_pages_table(spark):
    rows = [(1, "u", PAGE % "<article><p>Ä of</p></article>"), (2, None, None), (None, "v", ""), (1, "u", PAGE % "<article><p>Ä of</p></article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", "Ä of", 4), (2, None, "", 0), (None, "v", "", 0), (1, "u", "Ä of", 4)], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0


PROSE = "This is the text that a reader of the page came for, and it is as long as it has to be for the rules of this test. " * 2
PARAGRAPHS = "".join(f"<p>{PROSE}{k}</p>" for k in range(3))
SAID = "\n".join(f"{PROSE}{k}" for k in range(3))


@pytest.mark.parametrize(
    "page",
    [
        f'<article><div class="elementor-widget elementor-widget-text-editor">{PARAGRAPHS}</div></article>',
        f'<div class="site has-sidebar">{PARAGRAPHS}<div class="sidebar">{PROSE}</div><div class="site-footer"><p>The imprint of it.</p></div></div>',
        f'<div class="has-sidebar"><article>{PARAGRAPHS}</article><div class="sidebar-box"><p>Near to it.</p></div></div>',
        f'<article>{PARAGRAPHS}<div class="comments">{PARAGRAPHS}</div></article>',
    ],
)
def test_page_text_keeps_containers_with_text(page):
    assert html_text.main_text(page)[0] == SAID


def test_page_text_keeps_signs_and_formulas_of_articles():
    page = "<article><p>It is \xa9 the owner.</p><p>The sum <math><mi>x</mi></math> is it.</p></article>"
    assert html_text.main_text(page)[0] == "It is \xa9 the owner.\nThe sum x is it."


@pytest.mark.parametrize("part", ["<div>x</p>", "<object>y", "<a ", "<div class='x-ad'>z", "</div>", "<span class='ad'>q"])
def test_page_text_takes_linear_time(part):
    begin = time.time()
    html_text.main_text(part * 100_000)
    assert time.time() - begin < 8
