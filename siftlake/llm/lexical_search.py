"""Ranked lexical search by pipelined term partitioning.

Documents lie in blocks; the postings of a term lie with the owner of that term, and owners form stages from
rare to common terms. Bundles of items carry sparse accumulators (score by document of a block) through
the stages: in each, a cogroup meets a bundle with what the stage's owners have for it, adds integer
contributions, and drops what can no longer be among the best.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, written
from siftlake.llm.words import word_blocks

#: Documents of a block, and postings after which a block ends early.
BLOCK_DOCS, BLOCK_POSTINGS = 4000, 2_000_000
#: Items of a bundle, about.
BUNDLE = 256
#: Bytes up to which a table of counted size is broadcast.
BROADCAST = 16 << 20
#: Bits of the broadcast filter of item terms: 128 KiB whatever the number of items.
FILTER_BITS = 1 << 20
#: A term belongs to the first stage whose share of all documents it doesn't exceed.
STAGE_SHARES = (0.001, 0.01, 0.1, 1.0)
#: No contribution reaches a term's weight times this.
LIMIT = 1_000_000

INDEX = "block long, term binary, n long, total long, docs binary, counts binary, ids binary, named binary"
CARRIED = "bundle long, block long, m binary, ids binary, named binary, slots binary, sizes binary, places binary, scores binary"


def _small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast where `size`, a counted bound in bytes, is small; else Spark chooses the join."""
    return F.broadcast(df) if size <= BROADCAST else df


def _pack(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of all rows of an item; terms are bytes."""

    def make():
        def apply(rows):
            terms = [sorted({w for ws in word_blocks(t) for w in ws}) for t in rows["_bytes"]]
            return {"item_id": rows["item_id"], "terms": terms}

        return apply

    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    found = arrow_map(items.select("item_id", F.col("text").cast("binary").alias("_bytes")), schema, make)
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """One bit for each hash of a term: `FILTER_BITS` bits, put together from at most as many / 32 rows."""
    bit = F.pmod(F.crc32("term"), F.lit(FILTER_BITS))
    words = (
        terms.select((bit / 32).cast("long").alias("word"), (bit % 32).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in words:
        out[row["word"]] = row["bits"]
    return out


class _Block:
    """Postings of consecutive documents of one task."""

    def __init__(self):
        self.ids: list[int] = []
        self.named: list[bool] = []
        self.lengths: list[int] = []
        self.docs: dict[bytes, list[int]] = {}
        self.counts: dict[bytes, list[int]] = {}
        self.postings = 0

    def rows(self, number: int) -> list[dict]:
        out = [
            {
                "block": number, "term": None, "n": sum(x > 0 for x in self.lengths), "total": sum(self.lengths), "docs": None,
                "counts": _pack(self.lengths, "<i8"), "ids": _pack(self.ids, "<i8"), "named": _pack(self.named, "?"),
            }
        ]
        for term, docs in self.docs.items():
            counts = self.counts[term]
            out.append({"block": number, "term": term, "n": len(docs), "total": sum(counts), "docs": _pack(docs, "<u2"),
                        "counts": _pack(counts, "<u4"), "ids": None, "named": None})
        return out


def index_documents(docs: DataFrame, bits: np.ndarray | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of postings, in `INDEX` columns.

    A row with a term holds its documents (places in the block) and counts there; the row without a term holds ids and
    numbers of terms of the block's documents. `bits` leaves out terms that its filter excludes.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(INDEX))
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = None if shared is None else shared.value
        wanted: dict[bytes, bool] = {}
        number = TaskContext.get().partitionId() << 32
        block = _Block()

        def flush():
            rows = block.rows(number)
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 5000], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tf: Counter = Counter()
                    for words in word_blocks(text):
                        tf.update(words)
                    place = len(block.ids)
                    block.ids.append(0 if doc_id is None else doc_id)
                    block.named.append(doc_id is not None)
                    block.lengths.append(sum(tf.values()))
                    for term, count in tf.items():
                        keep = wanted.get(term)
                        if keep is None:
                            if len(wanted) > 500_000:
                                wanted.clear()
                            bit = zlib.crc32(term) % FILTER_BITS
                            keep = wanted[term] = filled is None or bool(filled[bit >> 5] >> (bit & 31) & 1)
                        if keep:
                            block.docs.setdefault(term, []).append(place)
                            block.counts.setdefault(term, []).append(count)
                            block.postings += 1
                    if len(block.ids) >= block_docs or block.postings >= BLOCK_POSTINGS:
                        yield from flush()
                        number, block = number + 1, _Block()
        if block.ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, INDEX)


def _weight(n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (F.col("df") * 2.0 + 1))).cast("long")


def _stage(n: int) -> Column:
    out = F.lit(len(STAGE_SHARES) - 1)
    for k in range(len(STAGE_SHARES) - 2, -1, -1):
        out = F.when(F.col("df") <= n * STAGE_SHARES[k], k).otherwise(out)
    return out


def _add_up(left: pd.DataFrame, right: pd.DataFrame) -> tuple[pd.Series, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """One bundle in one block after one stage: (its row, documents and scores by slot of an item)."""
    row = left.iloc[0]
    m = np.frombuffer(row["m"], "<i8")
    keep, begin = np.frombuffer(row["keep"], "<i8"), np.frombuffer(row["begin"], "?")
    slots, sizes = np.frombuffer(row["slots"], "<i4"), np.frombuffer(row["sizes"], "<i4")
    places, scores = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["scores"], "<i8")
    ends = np.cumsum(sizes)
    held = {int(s): (places[e - n : e], scores[e - n : e]) for s, n, e in zip(slots, sizes, ends)}
    added: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {s: [] for s in held}
    for w, who, docs, counts in zip(right["w"], right["who"], right["docs"], right["counts"]):
        docs, tf = np.frombuffer(docs, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64)
        part = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        for slot in who:
            added.setdefault(int(slot), []).append((docs, part))
    out = {}
    for slot in sorted(added):
        total = np.zeros(len(m), np.int64)
        if slot in held:
            total[held[slot][0]] = held[slot][1]
        before = total > 0
        for docs, part in added[slot]:
            total[docs] += part
        stays = (total > 0) & (total >= keep[slot])
        if not begin[slot]:
            stays &= before
        found = np.flatnonzero(stays)
        if len(found):
            out[slot] = (found, total[found])
    return row, out


def _carry(top: int):
    """After a stage: the accumulators, and each item's best scores in the block."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame()
        row, found = _add_up(left, right)
        best = [(s, int(x)) for s, (_, v) in found.items() for x in np.sort(v)[::-1][:top]]
        out = {
            **{c: row[c] for c in ("bundle", "block", "m", "ids", "named")},
            "slots": _pack(list(found), "<i4"),
            "sizes": _pack([len(p) for p, _ in found.values()], "<i4"),
            "places": b"".join(_pack(p, "<u2") for p, _ in found.values()),
            "scores": b"".join(_pack(v, "<i8") for _, v in found.values()),
            "best_slot": [s for s, _ in best],
            "best_score": [x for _, x in best],
        }
        return pd.DataFrame([out])

    return run


def _finish(top: int):
    """After the last stage: each item's best documents of the block."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"bundle": [], "slot": [], "doc_id": [], "score": []}
        if len(left):
            row, found = _add_up(left, right)
            ids, named = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], "?")
            for slot, (places, scores) in found.items():
                order = np.lexsort((ids[places], ~named[places], -scores))[:top]
                out["bundle"] += [row["bundle"]] * len(order)
                out["slot"] += [slot] * len(order)
                out["doc_id"] += [int(ids[p]) if named[p] else None for p in places[order]]
                out["score"] += scores[order].tolist()
        return pd.DataFrame({k: pd.Series(v, dtype="Int64") for k, v in out.items()})

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item with a score above 0.

    The score is a sum of integers over the item's distinct terms (see README); equal scores go by ascending
    doc_id. Owners of rare terms come first. After each stage an item's `top`-th best partial score is a
    floor of its final one, so an accumulator goes when it can't reach that floor with all the weight left,
    and none is begun when that weight alone can't: nothing that belongs to the result is lost, whatever the data.

    Null or empty texts have no terms: such a document is never found and not counted, such an item has no rows. Rows that
    repeat an item_id are one item with the terms of all its rows; a null item_id is an item; documents that repeat
    a doc_id are ranked each; a null doc_id comes last among equals. Empty tables give an empty result.
    Other columns are not read.
    """
    wanted = written(item_terms(items), "search-terms")
    index = written(index_documents(docs, term_filter(wanted), block_docs), "search-index")
    whole = index.where("term is null")
    sums = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n_docs, n_terms = int(sums[0]), max(1, int(sums[1]))
    known = wanted.select("item_id").distinct()
    n_items = known.count()
    bundles = max(1, math.ceil(n_items / BUNDLE))
    slotted = written(
        known.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
        .withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1),
        "search-items",
    )
    weights = (
        index.where("term is not null")
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
        .select("term", _weight(n_docs).alias("w"), _stage(n_docs).alias("stage"))
        .where("w > 0")
    )
    named = F.col("i.item_id").eqNullSafe(F.col("t.item_id"))
    routes = written(
        wanted.alias("t")
        .join(weights, "term")
        .join(slotted.alias("i"), named)
        .select("term", "w", "stage", "bundle", "slot"),
        "search-routes",
    )
    last = len(STAGE_SHARES) - 1
    # What the stages after each one can still add, by item.
    left = [F.sum(F.when(F.col("stage") > k, F.col("w") * LIMIT).otherwise(0)) for k in range(-1, last + 1)]
    ahead = routes.groupBy("bundle", "slot").agg(F.array(*left).alias("ahead"))
    ahead = written(slotted.select("bundle", "slot").join(ahead, ["bundle", "slot"], "left"), "search-ahead")
    owners = routes.groupBy("stage", "term", "w", "bundle").agg(F.sort_array(F.collect_list("slot")).alias("who"))
    postings = written(
        index.where("term is not null")
        .join(_small(owners, routes.count() * 64), "term")
        .select("stage", "bundle", "block", "w", "who", "docs", "counts"),
        "search-postings",
    )

    kind = "bundle long, block long, m binary, ids binary, named binary"
    lengths = whole.select("block", "counts", "ids", "named")

    schema = to_arrow_schema(T.StructType.fromDDL(kind))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["counts"], "<i8")
                m = _pack(100 - 90 + (90 * n * n_docs) // n_terms, "<i8")
                out = [{"bundle": b, "block": row["block"], "m": m, "ids": row["ids"], "named": row["named"]} for b in range(bundles)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    empty = [F.lit(b"").cast("binary").alias(c) for c in ("slots", "sizes", "places", "scores")]
    state = lengths.mapInArrow(spread, kind).select("*", *empty)
    floors = ahead.select("bundle", "slot", F.lit(0).cast("long").alias("floor"))
    for stage in range(last + 1):
        gates = _gates(ahead.join(floors, ["bundle", "slot"], "left"), stage)
        carried = state.join(_small(gates, n_items * 16), "bundle")
        own = postings.where(F.col("stage") == stage).drop("stage")
        meeting = carried.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block"))
        if stage == last:
            found = meeting.applyInPandas(_finish(top), "bundle long, slot int, doc_id long, score long")
            break
        after = meeting.applyInPandas(_carry(top), CARRIED + ", best_slot array<int>, best_score array<long>")
        table = written(after, f"search-stage{stage}")
        state = table.drop("best_slot", "best_score")
        best = table.select("bundle", F.inline(F.arrays_zip("best_slot", "best_score"))).toDF("bundle", "slot", "score")
        place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score")))
        floors = (
            best.withColumn("_at", place)
            .where(F.col("_at") <= top)
            .groupBy("bundle", "slot")
            .agg(F.when(F.count(F.lit(1)) == top, F.min("score")).otherwise(0).alias("floor"))
        )
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(slotted, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")


def _gates(rows: DataFrame, stage: int) -> DataFrame:
    """By bundle: the least score that stays after `stage`, and whether a document may begin in it, by slot.

    `ahead` lists what is left before the first stage and after each.
    """
    floor, ahead = F.coalesce("floor", F.lit(0).cast("long")), F.coalesce("ahead", F.array(*[F.lit(0).cast("long")] * 5))
    one = rows.select(
        "bundle",
        "slot",
        (floor - ahead[stage + 1]).alias("keep"),
        (ahead[stage] >= floor).alias("begin"),
    )

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot")
        return pd.DataFrame(
            [{"bundle": key[0], "keep": _pack(part["keep"], "<i8"), "begin": _pack(part["begin"], "?")}]
        )

    return one.groupBy("bundle").applyInPandas(pack, "bundle long, keep binary, begin binary")
