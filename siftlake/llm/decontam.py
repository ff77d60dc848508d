"""Benchmark decontamination: a set of benchmark windows of counted size scanned over all documents."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without, written

# Words on UTF-8 bytes: every byte of a character beyond ASCII is 0x80 or more.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of benchmark text that are broadcast as one set; a larger benchmark is joined.
SET_WORDS = 2_000_000
#: Bits of the filter before that join: 2 MiB, whatever the benchmark.
FILTER_BITS = 1 << 24

OUT = ["n_words", "n_hit", "items", "contaminated", "clean_text"]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def _rolled(ids: np.ndarray, span: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each run of `span` numbers."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(span):
        out *= BASE
        out += ids[j : j + n]
    return out


class WindowSet:
    """Windows of benchmark items: numbers of words, hash tables by window length, owners."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            span = min(window, len(ids))
            group = found.setdefault(span, {})
            for i in range(len(ids) - span + 1):
                group.setdefault(tuple(ids[i : i + span]), set()).add(name)
        self.groups = []
        for span, windows in sorted(found.items()):
            ids = np.array(list(windows), np.uint64).reshape(-1, span)
            hashes = np.array([_rolled(row, span)[0] for row in ids], np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(windows.values())
            filled = np.zeros(1 << 16, bool)
            filled[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.groups.append((span, hashes[order], ids[order], [owners[k] for k in order], filled))

    def scan(self, words: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For each document: a flag for each word inside a verified window, and the items."""
        sizes = [len(w) for w in words]
        starts = np.cumsum([0] + [n + 1 for n in sizes])  # one 0 stands between documents
        ids = np.zeros(int(starts[-1]), np.uint64)
        get = self.vocabulary.get
        for at, ws in zip(starts, words):
            ids[at : at + len(ws)] = [get(w, 0) for w in ws]
        change = np.zeros(len(ids) + 1, np.int64)
        items: list[set[str]] = [set() for _ in words]
        for span, hashes, known, owners, filled in self.groups:
            rolled = _rolled(ids, span)
            near = np.flatnonzero(filled[(rolled >> np.uint64(48)).astype(np.int64)])
            first = np.searchsorted(hashes, rolled[near], "left")
            last = np.searchsorted(hashes, rolled[near], "right")
            for at, lo, hi in zip(near[first < last], first[first < last], last[first < last]):
                for k in range(lo, hi):  # equal hashes are told apart by their words
                    if np.array_equal(ids[at : at + span], known[k]):
                        change[at] += 1
                        change[at + span] -= 1
                        items[int(np.searchsorted(starts, at, "right")) - 1] |= owners[k]
        inside = np.cumsum(change[:-1]) > 0
        return [inside[a : a + n] for a, n in zip(starts, sizes)], items


def _without_hits(text: bytes, hit: np.ndarray) -> str:
    """The text less each run of hit words, from its first word to its last."""
    spans = [m.span() for m in WORD.finditer(text.lower())]
    out, at, k = [], 0, 0
    while k < len(spans):
        if hit[k]:
            end = k
            while end + 1 < len(spans) and hit[end + 1]:
                end += 1
            out.append(text[at : spans[k][0]])
            at, k = spans[end][1], end
        k += 1
    return b"".join([*out, text[at:]]).decode()


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(n, words, item): the distinct windows of items; words are joined by blanks."""

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            out = []
            for text in rows["text"]:
                w = words_of(text)
                n = min(window, len(w))
                out.append(sorted({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}) if n else [])
            return {"item": rows["item"], "n": [min(window, len(words_of(t))) for t in rows["text"]], "all": out}

        return apply

    found = arrow_map(items, "item string, n int, all array<binary>", make)
    return found.select("n", F.explode("all").alias("words"), "item").distinct()


def _joined_places(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_row, places) and (_row, items) of documents (_row, _bytes) whose windows are among `windows`.

    Only windows that pass a filter of fixed size are joined; they join by their words, so nothing is left to verify.
    """
    spans = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most as many as a window has words
    bit = F.pmod(F.crc32("words"), F.lit(FILTER_BITS))
    cells = windows.withColumn("_bit", bit).select(
        (F.col("_bit") / 32).cast("long").alias("cell"), F.expr("shiftleft(1L, cast(_bit % 32 as int))").alias("bits")
    )
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        filled[row["cell"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def make():
        cells = shared.value

        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"_row": [], "at": [], "n": [], "words": []}
            for number, text in zip(rows["_row"], rows["_bytes"]):
                w = words_of(text)
                for n in spans:
                    for i in range(len(w) - n + 1):
                        words = b" ".join(w[i : i + n])
                        k = zlib.crc32(words) % FILTER_BITS
                        if cells[k >> 5] >> (k & 31) & 1:
                            out["_row"].append(number)
                            out["at"].append(i)
                            out["n"].append(n)
                            out["words"].append(words)
            return out

        return apply

    seen = arrow_map(docs, "_row long, at int, n int, words binary", make, rows=50)
    hits = written(seen.join(windows, ["n", "words"]).select("_row", "at", "n", "item"), "decontam-hits")
    places = hits.select("_row", "at", "n").distinct().groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("_places"))
    items = hits.select("_row", "item").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    return places, items


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, set_words: int = SET_WORDS, with_text: bool = True
) -> DataFrame:
    """Words of each document inside windows of the benchmark, and what is left without them.

    Adds `n_words`, `n_hit`, `items` (sorted ids of items with occurring windows), `contaminated`
    (a twentieth of the words or more are hit) and `clean_text` (the text less the hit spans). Input
    columns with these names give way. Windows of all lengths are found by rolling hashes
    against a broadcast set and compared word by word. The benchmark's size is counted first: beyond `set_words` nothing of
    it goes through the driver but a filter of fixed size, and windows that pass it are joined as rows.

    Null or empty texts have no words and no hits (a null text stays null); items without words
    have no window; equal items keep their own ids; a null item_id reads ''; empty tables give
    no hits or no rows.
    """
    docs = without(docs, OUT)
    if docs.schema["text"].dataType.simpleString() != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    items = _items(benchmark)
    # A word and its separator take two bytes at least.
    bound = items.agg(F.sum(F.length("text"))).first()[0] or 0
    fits = bound <= 2 * set_words
    own = [f for f in docs.schema.fields if with_text or f.name != "text"]
    names = [f.name for f in own]
    if fits:
        kept = WindowSet([(r[0], bytes(r[1])) for r in items.collect()], window)
        shared = docs.sparkSession.sparkContext.broadcast(kept)
    else:
        docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-docs")
        slim = docs.select("_row", F.col("text").cast("binary").alias("_bytes"))
        for more in _joined_places(slim, written(_windows(items, window), "decontam-windows")):
            docs = docs.join(more, "_row", "left")

    def make():
        def found(rows: dict[str, list], words: list) -> tuple[list[np.ndarray], list[list[str]]]:
            if fits:
                flags, who = shared.value.scan(words)
                return flags, [sorted(w) for w in who]
            flags = [np.zeros(len(w), bool) for w in words]
            for flag, places in zip(flags, rows["_places"]):
                for p in places or ():
                    flag[p["at"] : p["at"] + p["n"]] = True
            return flags, [i or [] for i in rows["_items"]]

        def apply(rows: dict[str, list]) -> dict[str, list]:
            texts = rows["_bytes"]
            words = [words_of(t) for t in texts]
            flags, who = found(rows, words)
            hits = [int(f.sum()) for f in flags]
            out = {n: rows[n] for n in names}
            out["n_words"] = [len(w) for w in words]
            out["n_hit"] = hits
            out["items"] = who
            out["contaminated"] = [h > 0 and 20 * h >= len(w) for h, w in zip(hits, words)]
            if with_text:
                out["clean_text"] = [
                    _without_hits(t, f) if h else (None if t is None else t.decode())
                    for t, f, h in zip(texts, flags, hits)
                ]
            return out

        return apply

    schema = docs.select(*[F.col(f"`{n}`") for n in names]).schema
    for name, kind in zip(OUT, ["long", "long", T.ArrayType(T.StringType()), "boolean", "string"]):
        if with_text or name != "clean_text":
            schema = schema.add(name, kind)
    joined = [] if fits else ["_places", "_items"]
    source = docs.select(*[F.col(f"`{n}`") for n in names], *joined, F.col("text").cast("binary").alias("_bytes"))
    return arrow_map(source, schema, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """Remove contaminated documents (`remove="documents"`), or the hit spans of all (`"spans"`).

    Documents without text or words stay; empty tables give an empty result, an empty benchmark removes nothing.
    """
    found = benchmark_hits(docs, benchmark, with_text=remove == "spans" or "text" in docs.columns, **options)
    if remove == "documents":
        return found.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove == "spans":
        rest = [F.col("clean_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
        return found.select(*rest)
    raise ValueError(f"remove: {remove}")
