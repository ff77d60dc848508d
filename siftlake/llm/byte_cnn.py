"""Quality classifier: a convolutional network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without

WIDTH = 8
FILTERS, HIDDEN = 24, 16
#: Places of the filters in one chunk, and from one chunk to the next: chunks overlap by an eighth.
CHUNK, HOP = 256, 224
#: Bounds of the labelled sample that the network learns from: documents, and bytes of one.
TRAIN_DOCS, TRAIN_BYTES = 4000, 65_536
OUT = ["held_out", "score", "predicted"]


def _padded(text: bytes) -> np.ndarray:
    """Bytes of a text, at least one filter wide."""
    data = np.frombuffer(text, np.uint8)
    short = WIDTH - len(data)
    return data if short <= 0 else np.concatenate([data, np.zeros(short, np.uint8)])


def _chunk_starts(places: int) -> np.ndarray:
    """First places of the chunks that cover all places."""
    return np.arange(0, max(1, places - (CHUNK - HOP)), HOP)


class Network:
    """Filters over 8 bytes, at every byte; their maxima over each chunk; a hidden layer for each
    chunk; maxima and means of that over the document; one logistic unit.

    The share of a chunk that text fills goes into its hidden layer, as maxima over fewer places are lower.
    """

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed).normal
        self.filters = draw(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = draw(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.last = draw(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.last_bias = np.zeros(1, np.float32)

    NAMES = ("filters", "bias", "hidden", "hidden_bias", "last", "last_bias")

    def _pairs(self) -> np.ndarray:
        """Filter parts for each pair of neighbouring bytes: half as many look-ups when scoring."""
        f = self.filters.reshape(WIDTH // 2, 2, 256, FILTERS)
        return (f[:, 0, :, None] + f[:, 1, None, :]).reshape(WIDTH // 2, 65536, FILTERS)

    def _pooled(self, data: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over each chunk of one text, and how full each chunk is."""
        codes = data[:-1].astype(np.int32) * 256 + data[1:]
        places = len(data) - WIDTH + 1
        starts = _chunk_starts(places)
        ends = np.minimum(starts + CHUNK, places)
        out = np.empty((len(starts), FILTERS), np.float32)
        for at in range(0, len(starts), 1024):  # bounded memory for long texts
            s, e = starts[at : at + 1024], ends[at : at + 1024]
            lo, hi = int(s[0]), int(e[-1])
            got = pairs[0].take(codes[lo:hi], axis=0)
            for j in range(1, WIDTH // 2):
                got += pairs[j].take(codes[lo + 2 * j : hi + 2 * j], axis=0)
            cuts = np.stack([s - lo, e - lo], axis=1).ravel()
            if cuts[-1] == len(got):
                cuts = cuts[:-1]
            out[at : at + 1024] = np.maximum.reduceat(got, cuts, axis=0)[::2]
        return out + self.bias, ((ends - starts) / CHUNK).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not hasattr(self, "_ready"):
            self._ready = self._pairs()
        parts = [self._pooled(_padded(t), self._ready) for t in texts]
        if not parts:
            return np.empty(0)
        pooled = np.concatenate([p[0] for p in parts])
        full = np.concatenate([p[1] for p in parts])
        sizes = [len(p[1]) for p in parts]
        _, doc = self._upper(pooled, full, np.repeat(np.arange(len(parts)), sizes), len(parts))
        return 1 / (1 + np.exp(-(doc @ self.last + self.last_bias[0]).astype(np.float64)))

    def _upper(self, pooled, full, owner, n):
        """Hidden layer of each chunk, and maxima and means by document (chunks are in document order)."""
        x = np.concatenate([np.maximum(pooled, 0), full[:, None]], axis=1)
        h = np.maximum(x @ self.hidden + self.hidden_bias, 0)
        first = np.searchsorted(owner, np.arange(n))
        count = np.bincount(owner, minlength=n).astype(np.float32)
        doc = np.concatenate(
            [np.maximum.reduceat(h, first, axis=0), np.add.reduceat(h, first, axis=0) / count[:, None]], axis=1
        )
        return h, doc

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 48, rate: float = 0.004) -> None:
        """Adam on the logistic loss; gradients pass through the maxima to the places that gave them."""
        rng = np.random.default_rng(5)
        y = np.array(labels, np.float32)
        data = [_padded(t) for t in texts]
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.NAMES}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                step += 1
                grads = self._gradients([data[i] for i in chosen], y[chosen])
                slow = rate * (1 - epoch / epochs) ** 0.5
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w = getattr(self, name)
                    w -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.__dict__.pop("_ready", None)

    def _gradients(self, data: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        span = CHUNK - 1 + WIDTH
        windows, lengths, owner = [], [], []
        for n, text in enumerate(data):
            places = len(text) - WIDTH + 1
            for s in _chunk_starts(places):
                part = text[s : s + span]
                lengths.append(min(CHUNK, places - s))
                windows.append(np.pad(part, (0, span - len(part))))
                owner.append(n)
        bytes_, lengths, owner = np.array(windows), np.array(lengths), np.array(owner)
        got = np.zeros((len(bytes_), CHUNK, FILTERS), np.float32)
        for j in range(WIDTH):
            got += self.filters[j].take(bytes_[:, j : j + CHUNK], axis=0)
        got[np.arange(CHUNK)[None, :] >= lengths[:, None]] = -np.inf
        where = got.argmax(axis=1)
        pooled = np.take_along_axis(got, where[:, None], axis=1)[:, 0] + self.bias
        full = (lengths / CHUNK).astype(np.float32)
        n = len(data)
        h, doc = self._upper(pooled, full, owner, n)
        p = 1 / (1 + np.exp(-(doc @ self.last + self.last_bias[0])))
        d = ((p - y) / n).astype(np.float32)
        grads = {"last": doc.T @ d, "last_bias": np.array([d.sum()], np.float32)}
        d_doc = d[:, None] * self.last
        count = np.bincount(owner, minlength=n).astype(np.float32)
        d_h = (d_doc[:, HIDDEN:] / count[:, None])[owner]
        best = h >= doc[:, :HIDDEN][owner]
        ties = np.add.reduceat(best.astype(np.float32), np.searchsorted(owner, np.arange(n)), axis=0)
        d_h = (d_h + best * (d_doc[:, :HIDDEN] / ties)[owner]) * (h > 0)
        x = np.concatenate([np.maximum(pooled, 0), full[:, None]], axis=1)
        grads["hidden"], grads["hidden_bias"] = x.T @ d_h, d_h.sum(axis=0)
        d_pool = (d_h @ self.hidden.T)[:, :FILTERS] * (pooled > 0)
        grads["bias"] = d_pool.sum(axis=0)
        out = np.zeros_like(self.filters)
        chunk = np.arange(len(bytes_))[:, None]
        column = np.arange(FILTERS)[None, :]
        for j in range(WIDTH):
            cell = bytes_[chunk, where + j].astype(np.int64) * FILTERS + column
            out[j] = np.bincount(cell.ravel(), d_pool.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        grads["filters"] = out
        return grads


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES) -> DataFrame:
    """(text bytes, label) of at most `limit` labelled documents that are not held out, none
    longer than `most` bytes, chosen by a hash of the id; an id with several labels takes the highest."""
    known = labels.where(F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most)
    # The ids are chosen first, so texts of a bounded number of rows leave the executors.
    chosen = (
        rows.select("doc_id").join(known, "doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return rows.join(chosen, "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "label"
    )


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES) -> Network | None:
    """A network fitted on the bounded sample; None without labelled rows."""
    rows = training_sample(docs, labels, limit, most).collect()
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), bytes(r["bytes"])))
    if not rows:
        return None
    network = Network()
    network.fit([bytes(r["bytes"]) for r in rows], [r["label"] for r in rows])
    return network


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES
) -> DataFrame:
    """Adds `held_out`, `score` (probability of label 1, from the bytes of the whole text alone) and `predicted`;
    input columns of these names give way, and the text is left out.

    The network learns on the driver from at most `limit` labelled documents of at most `most` bytes whose id is
    not held out; all documents are scored, whatever their length.

    Null and empty texts are scored as one chunk without text; a null doc_id is not held out; labels that are
    null are left out; without labels every score is 0.5; rows that repeat stay; an empty table gives an
    empty result.
    """
    docs = without(docs, OUT)
    network = train(docs.select("doc_id", "text"), labels, limit, most)
    names = [c for c in docs.columns if c != "text"]
    source = docs.withColumn("_bytes", F.coalesce("text", F.lit("")).cast("binary")).drop("text")
    fields = [f for f in source.schema.fields if f.name != "_bytes"]
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            model = shared.value
            got = [0.5] * len(rows["_bytes"]) if model is None else model.scores(rows["_bytes"]).tolist()
            return {n: rows[n] for n in names} | {"score": got}

        return apply

    out = arrow_map(source, T.StructType(fields).add("score", "double"), make, rows=64)
    return out.withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
