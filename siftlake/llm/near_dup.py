"""MinHash near-duplicates: circulant signatures, banding, and exact links on whole sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlake.llm.common import arrow_map, written
from siftlake.llm.components import components

SHINGLE = 5
BANDS, ROWS = 40, 8
#: Coordinates of a signature: the first BANDS * ROWS make the bands, all of them the estimate.
K = 480
#: Size of the circle that both permutations act on.
CIRCLE = 1 << 22
#: Members of a bucket that are compared with each other in one task.
BLOCK = 256
#: Pairs whose signatures agree in less than the limit minus this share are not verified: nearly five
#: standard deviations of the estimate at the limit of 0.85 (0.0163 with 480 coordinates).
MARGIN = 0.08
WORDS_REMEMBERED = 300_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Hashes of words, worked out once in each worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of all words where there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    span = min(SHINGLE, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)])
    return np.unique(out)


@functools.lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """The second permutation, with its start repeated at its end: row i holds its K shifts at i."""
    order = np.random.default_rng(20240607).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: K - 1]]), K)


def signature(hashes: np.ndarray) -> np.ndarray:
    """K coordinates: coordinate k is the least value of the second permutation, shifted by k
    places, over the set as placed by the first one."""
    place = hashes & np.uint64(CIRCLE - 1)
    # First permutation of the circle: odd multiplications and shifts are one-to-one on it.
    place = (place * np.uint64(2654435761) + np.uint64(12345)) & np.uint64(CIRCLE - 1)
    place ^= place >> np.uint64(11)
    place = (place * np.uint64(2246822519)) & np.uint64(CIRCLE - 1)
    circle, out = _circle(), None
    for at in range(0, len(place), 2048):  # bounded memory for long documents
        low = circle[place[at : at + 2048].astype(np.int64)].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: a digest of its set, its size, signature bytes and bands."""
    fields = [f for f in docs.schema.fields if f.name == "doc_id"]
    schema = T.StructType(fields)
    schema = schema.add("_content", "long").add("_set", "binary").add("n_shingles", "long")
    schema = schema.add("_sig", "binary").add("_bands", T.ArrayType(T.LongType()))

    def make():
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

        def apply(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("_set", "n_shingles", "_sig", "_bands")}
            for text in rows["_bytes"]:
                hashes = shingles(text)
                out["n_shingles"].append(len(hashes))
                if not len(hashes):
                    for name in ("_set", "_sig", "_bands"):
                        out[name].append(None)
                    continue
                out["_set"].append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sig = signature(hashes)
                out["_sig"].append(sig.astype(np.uint8).tobytes())
                bands = salt.copy()
                for j in range(ROWS):
                    bands = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) + sig[j : BANDS * ROWS : ROWS])
                out["_bands"].append(bands.view(np.int64).tolist())
            return {"doc_id": rows["doc_id"], "_content": rows["_content"]} | out

        return apply

    text = F.coalesce(F.col("text"), F.lit(""))
    return arrow_map(docs.select("doc_id", F.xxhash64(text).alias("_content"), text.cast("binary").alias("_bytes")), schema, make)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets of the documents named in `nodes`."""
    schema = T.StructType([f for f in docs.schema.fields if f.name == "doc_id"])
    schema = schema.add("_hashes", T.ArrayType(T.LongType()))

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            return {
                "doc_id": rows["doc_id"],
                "_hashes": [shingles(t).view(np.int64).tolist() for t in rows["_bytes"]],
            }

        return apply

    chosen = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return arrow_map(chosen.select("doc_id", F.col("text").cast("binary").alias("_bytes")), schema, make)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Many pairs may share one side; such joins are inner, so Spark splits them at run time.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("_hashes").alias("_ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("_hashes").alias("_hb"))
    rows = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("_ha", "_hb")).cast("long")
    rows = rows.withColumn("_both", both)
    union = F.size("_ha") + F.size("_hb") - F.col("_both")
    return rows.where(F.lit(100) * F.col("_both") >= F.lit(percent) * union).select("a", "b").distinct()


def _close_pairs(members: DataFrame, heads: DataFrame, percent: int, hubs: bool) -> DataFrame:
    """Pairs of different components in one bucket whose signatures and sizes may be similar enough.

    Members of a bucket are dealt to blocks of about BLOCK; every two blocks meet in one
    task. A pair is given in the first of its common buckets alone. With `hubs`, each member is paired only with
    the member of its block pair that is close to the most others, so a group around one text gives about as many
    pairs as members.
    """
    size = members.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_m"), F.min("_comp").alias("_c0"), F.max("_comp").alias("_c1")
    )
    size = size.where("_c0 != _c1").select("_bucket", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    # Both sides are tables, so that the join on a bucket of many members can be split.
    rows = members.join(written(size, "near-sizes"), "_bucket").join(heads, "node")
    # An id with several texts has several heads: each stands for its own buckets.
    rows = rows.where(F.array_contains("_bands", F.col("_bucket")))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select(
        "_bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_own", "node", "_comp", "n_shingles", "_sig", "_bands",
    )
    key = ["_bucket", "_i", "_j"]
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    node = members.schema["node"].dataType
    schema = T.StructType().add("a", node).add("b", node)
    arrow = to_arrow_schema(schema)
    least = percent / 100 - MARGIN

    def compare(group: pa.Table) -> pa.RecordBatch:
        nodes = group.column("node").to_pylist()
        own = group.column("_own").to_numpy()
        comp = group.column("_comp").to_numpy()
        n = group.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(group.column("_sig").to_pylist()), np.uint8).reshape(len(nodes), K)
        bands = group.column("_bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), BANDS)
        here = int(np.flatnonzero(bands[0] == group.column("_bucket")[0].as_py())[0])
        two = group.column("_i")[0].as_py() != group.column("_j")[0].as_py()
        close = np.zeros((len(nodes), len(nodes)), bool)
        for x in range(len(nodes)):
            ys = np.arange(x + 1, len(nodes))
            ok = comp[ys] != comp[x]
            if two:  # pairs inside a block meet in the task of that block alone
                ok &= own[ys] != own[x]
            ok &= 100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])
            ys = ys[ok]
            if len(ys):
                ys = ys[(sig[ys] == sig[x]).mean(axis=1) >= least]
                if not hubs:
                    ys = ys[~(bands[ys, :here] == bands[x, :here]).any(axis=1)]
                close[x, ys] = close[ys, x] = True
        if hubs:
            degree = close.sum(axis=1)
            best = np.where(close, degree[None, :], -1).argmax(axis=1)
            pairs = {(min(x, int(best[x])), max(x, int(best[x]))) for x in np.flatnonzero(degree)}
        else:
            pairs = set(zip(*np.nonzero(np.triu(close))))
        a = [min(nodes[x], nodes[y]) for x, y in pairs]
        b = [max(nodes[x], nodes[y]) for x, y in pairs]
        return pa.RecordBatch.from_arrays([pa.array(a, arrow[0].type), pa.array(b, arrow[1].type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far: at most two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = [table.column(k).to_numpy() for k in key]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = [0, *new.tolist()]
            for lo, hi in zip(starts, starts[1:]):
                yield compare(table.slice(lo, hi - lo))
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield compare(held)

    return rows.mapInArrow(run, schema).where("a != b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and _content, a hash of the text) of each document.

    Documents are linked when their sets of 5-word shingles have a Jaccard similarity of `percent` or
    more; components are taken over links. Equal sets are one class from the start, so
    copies are never paired. Classes meet in buckets of equal bands. In each bucket the smallest id is
    tried against the others first, then the best-connected members of blocks, and
    last all pairs of different components that their signatures don't rule out, block by block.
    Every link is confirmed on the whole sets (64-bit hashes of shingles). With 40 bands of 8
    coordinates a pair at similarity 0.85 is missed with a chance of 3 in a million.

    A null or empty text, or one of white space, has no shingles and links with nothing. A null
    doc_id keeps a null component and is kept. Rows that repeat id and text get equal rows. An
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows = written(_signed(docs), "near-rows")
    linked = rows.where(F.col("_set").isNotNull() & F.col("doc_id").isNotNull())
    # A table of its own, so that joins on a set that many documents share can be split.
    classes = written(linked.groupBy("_set").agg(F.min("doc_id").alias("node")), "near-classes")
    heads = (
        linked.join(classes.select(F.col("_set").alias("_s"), "node"), (F.col("_set") == F.col("_s")) & (F.col("doc_id") == F.col("node")))
        .select("node", "n_shingles", "_sig", "_bands")
        .dropDuplicates(["node", "_bands"])
    )
    heads = written(heads, "near-heads")
    bands = heads.select("node", F.explode("_bands").alias("_bucket"))
    shared = (
        bands.groupBy("_bucket")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("_top"), F.count(F.lit(1)).alias("_m"))
        .where("_m > 1 and pivot != _top")
    )
    shared = written(shared, "near-buckets")
    # A bucket of two is its own pair; larger ones fetch their members.
    members = written(
        bands.join(shared.where("_m > 2").select("_bucket", "pivot"), "_bucket"), "near-members"
    )
    stars = (
        shared.where("_m = 2").select(F.col("pivot").alias("a"), F.col("_top").alias("b"))
        .union(members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        .distinct()
    )
    stars = written(stars, "near-stars")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = written(_sets(docs, nodes), "near-sets")
    links = written(_verified(stars, sets, percent), "near-links")
    labels = components(links)
    tested = stars
    for hubs in (True, False):
        known = labels.select(F.col("node").alias("_n"), "label")
        open_ = (
            members.select("_bucket", "node")
            .join(known, F.col("node") == F.col("_n"), "left")
            .select("_bucket", "node", F.coalesce("label", "node").alias("_comp"))
        )
        open_ = written(open_, "near-open")
        pairs = _close_pairs(open_, heads.select("node", "n_shingles", "_sig", "_bands"), percent, hubs).join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        tested = tested.union(pairs)
        links = written(links.union(_verified(pairs, sets, percent)), "near-links")
        labels = components(links)
    known = labels.select(F.col("node").alias("_n"), "label")
    classes = classes.join(known, F.col("node") == F.col("_n"), "left").select(
        F.col("_set").alias("_s"), F.coalesce("label", "node").alias("component_id")
    )
    found = linked.join(classes, F.col("_set") == F.col("_s")).select("doc_id", "n_shingles", "component_id", "_content")
    alone = rows.where(F.col("_set").isNull() | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_content"
    )
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents less all but one of each component; rows that repeat id and text stay once.

    The bands are laid out for `percent` = 85, and links of lower similarity would be missed more often. Documents
    without words are linked with nothing and stay; a null doc_id counts as one; an empty table gives an empty result.
    """
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_kid"), F.col("_content").alias("_kc"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("_kid")) & (F.xxhash64(text) == F.col("_kc"))
    columns = docs.columns
    out = docs.join(kept.distinct(), same, "left_semi").withColumn("_kc", F.xxhash64(text))
    return out.dropDuplicates(["doc_id", "_kc"]).select(*[F.col(f"`{c}`") for c in columns])
