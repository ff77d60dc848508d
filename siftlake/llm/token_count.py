"""Token counts of documents of any length, by overlapping chunks spliced at proven boundaries."""

from __future__ import annotations

import functools

import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without, written
from siftlake.llm.pieces import BLANK, model_path

OUT = ["n_bytes", "n_tokens", "over_limit"]
KEY = ["doc_id", "_hash", "n_bytes"]
ZONE = "array<struct<at:long,before:long>>"


class Splicer:
    """A tokenizer with offsets, and the proof that a place is a boundary in every context."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.lead = {i: (int(names[i][1:-1], 16) & 0xC0) != 0x80 for i in range(n) if lib.is_byte(i)}
        self.width = [len(p) for p in names]
        # Merges make pieces only, so two signs that stand side by side in no piece are never joined.
        self.joined = {p[k : k + 2] for i, p in enumerate(names) if i not in self.lead for k in range(len(p) - 1)}

    def count(self, texts: list[str]) -> list[int]:
        return [len(i) for i in self.library.encode(texts, num_threads=1)]

    def starts(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and where each of its tokens starts."""
        normal, at, out = self.library.normalize(text), 0, []
        for i in self.library.encode(text, num_threads=1):
            lead = self.lead.get(i)
            out.append(at if lead is not False else at - 1)
            at += self.width[i] if lead is None else int(lead)
        if at != len(normal):
            raise ValueError(f"tokens cover {at} of {len(normal)} characters: the model is not of merge type")
        return normal, out

    def stable(self, normal: str, at: int) -> bool:
        return at > 0 and normal[at - 1 : at + 1] not in self.joined


@functools.lru_cache(maxsize=2)
def splicer_of(path: str) -> Splicer:
    return Splicer(path)


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Windows of `chunk` characters with `overlap` more on both sides, dealt out over the cluster."""
    schema = T.StructType(list(huge.select(*KEY).schema.fields))
    for name, kind in (("_k", "long"), ("_last", "boolean"), ("_from", "long"), ("_window", "string")):
        schema = schema.add(name, kind)

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in schema}
            for n, text in enumerate(rows["text"]):
                for k in range(0, max(1, -(-len(text) // chunk))):
                    start = max(0, k * chunk - overlap)
                    for c in KEY:
                        out[c].append(rows[c][n])
                    out["_k"].append(k)
                    out["_last"].append((k + 1) * chunk >= len(text))
                    out["_from"].append(start)
                    out["_window"].append(text[start : (k + 1) * chunk + overlap])
            return out

        return apply

    return arrow_map(huge, schema, make, rows=4).repartition("_hash", "_k")


def _zones(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Encodes each window: its tokens, and the stable boundaries in its two overlaps.

    A zone entry is a place in the document and the number of the window's tokens before it.
    """
    schema = T.StructType([f for f in chunks.schema.fields if f.name not in ("_from", "_window")])
    schema = schema.add("_tokens", "long")
    for name in ("_left", "_right"):
        schema = schema.add(name, T._parse_datatype_string(ZONE))
    names = [f.name for f in chunks.schema.fields if f.name not in ("_from", "_window")]

    def make():
        splicer = splicer_of(path)

        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: rows[n] for n in names}
            out |= {"_tokens": [], "_left": [], "_right": []}
            for k, start, text in zip(rows["_k"], rows["_from"], rows["_window"]):
                normal, starts = splicer.starts(text)
                lead = len(normal) - len(text)  # the blank sign that the normaliser puts first
                zones: tuple[list, list] = ([], [])
                for before, at in enumerate(starts):
                    place = start + at - lead
                    for zone, cut in zip(zones, (k * chunk, (k + 1) * chunk)):
                        if cut <= place < cut + overlap and splicer.stable(normal, at):
                            zone.append({"at": place, "before": before})
                out["_tokens"].append(len(starts))
                out["_left"].append(zones[0])
                out["_right"].append(zones[1])
            return out

        return apply

    return arrow_map(chunks, schema, make, rows=16)


def _spliced(zones: DataFrame) -> DataFrame:
    """Tokens of each document, null where two neighbours share no stable boundary.

    Up to the first shared boundary the left window counts, from there on the right one.
    """
    zones = zones.dropDuplicates([*KEY, "_k"])  # rows that repeat have equal chunks
    order = Window.partitionBy(*KEY).orderBy("_k")
    zones = zones.withColumn("_next", F.lead("_left").over(order))
    shared = F.expr(
        "filter(transform(_right, x -> struct(x.at as at, x.before - "
        "get(filter(_next, y -> y.at = x.at), 0).before as part)), z -> z.part is not null)"
    )
    part = F.when(F.col("_last"), F.col("_tokens")).otherwise(F.get(shared, F.lit(0))["part"])
    zones = zones.withColumn("_part", part)
    whole = F.count(F.lit(1)) == F.count("_part")
    return zones.groupBy(*KEY).agg(F.when(whole, F.sum("_part")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 4096,
    chunk: int = 32_768,
    overlap: int = 256,
) -> DataFrame:
    """Adds `n_bytes` (UTF-8), `n_tokens` and `over_limit`; input columns of these names give way.

    Documents of up to `chunk` characters are encoded whole. Longer ones are cut into overlapping
    windows that go to tasks of their own. Neighbours are spliced at the first token boundary that both
    have in their overlap and that no piece of the vocabulary reaches over. Documents without
    such a place are encoded again with an overlap eight times as wide, and so on, until one window holds
    them whole: the result always equals the count of the whole text.

    Null or empty texts have 0 bytes and tokens; rows that repeat stay; an empty table gives
    an empty result.
    """
    docs = without(docs, OUT)
    path = path or model_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
    keep = [c for c in docs.columns if c != "text"]
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = docs.where(~is_long)
    fields = T.StructType([f for f in small.schema.fields if f.name != "text"]).add("n_tokens", "long")

    def make():
        splicer = splicer_of(path)

        def apply(rows: dict[str, list]) -> dict[str, list]:
            return {n: rows[n] for n in keep} | {"n_tokens": splicer.count([t or "" for t in rows["text"]])}

        return apply

    counted = arrow_map(small, fields, make, rows=200)
    huge = docs.where(is_long).withColumn("_hash", F.xxhash64("text"))
    rounds, todo = [], huge.select(*KEY, "text")
    while True:
        found = written(_spliced(_zones(_chunks(todo, chunk, overlap), path, chunk, overlap)), "token-count")
        rounds.append(found.where(F.col("n_tokens").isNotNull()))
        open_ = found.where(F.col("n_tokens").isNull())
        if open_.isEmpty():
            break
        overlap, chunk = overlap * 8, max(chunk, overlap * 8)
        if overlap > chunk // 2:  # windows that are mostly overlap: take longer ones
            chunk = overlap * 4
        again = open_.select(*[F.col(c).alias(f"_o_{c}") for c in KEY])
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in KEY])
        todo = huge.select(*KEY, "text").join(again, same, "left_semi")
    total = functools.reduce(DataFrame.unionByName, rounds)
    total = total.select(*[F.col(c).alias(f"_o_{c}") for c in KEY], "n_tokens")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in KEY])
    rest = huge.select(*keep, "_hash").join(total, same).select(*keep, "n_tokens")
    return counted.unionByName(rest).withColumn("over_limit", F.col("n_tokens") > limit)
