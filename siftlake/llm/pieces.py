"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import string

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without

BLANK = "▁"
#: Segments that a worker remembers in each of two generations.
REMEMBERED = 300_000
#: Up to this length a segment's pairs are kept as a plain list, beyond it as a heap.
PLAIN = 40
OUT = ["ids", "decoded", "as_library"]


class _Known(dict):
    """Pieces of segments, in two generations: what was not met for a generation is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.unchecked = make, {}, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        out = self.older.get(part)
        if out is None:
            out = self.make(part)
            self.unchecked[part] = out
        if len(part) <= 2 * PLAIN:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out


class Agenda:
    """A vocabulary of scored pieces.

    Text is normalised as the model says. It is cut where no piece reaches over, as read from all
    pieces: before a blank sign that follows another sign, around line and tab signs that are in no
    longer piece, and before punctuation that no piece has after a letter or the like. Merges on one
    side of such a place never touch the other side, so segments are encoded on their own and
    remembered.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        special = self.silent | set(self.byte_of) | {lib.unk_id()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.unk, self.eos = lib.unk_id(), lib.eos_id()
        self.plain = [
            "" if i in self.silent else " ⁇ " if i == self.unk else p.replace(BLANK, " ")
            for i, p in enumerate(self.pieces)
        ]
        apart = not any(BLANK in p.lstrip(BLANK) for p in self.rank)
        self.lone = lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.rank))
        marks = set(string.punctuation)
        self.joined = {x for p in self.rank for x, y in zip(p, p[1:]) if y in marks and x not in marks | {BLANK}}
        rest = re.escape("".join(sorted(marks)))
        fine = f"{BLANK}*[{rest}]*[^{rest}{BLANK}{lone}]+|{BLANK}*[{rest}]+"
        ends = f"|{BLANK}+" + (f"|[{lone}]" if lone else "")
        parts = f"{BLANK}*[^{BLANK}{lone}]+{ends}"
        self.fine = re.compile(fine + ends if apart else "(?s).+").findall
        self.cut = re.compile(parts if apart else "(?s).+").findall
        self.known = _Known(self.segment)
        self.wrong: set[str] = set()

    def segment(self, text: str) -> tuple[int, ...]:
        """Merge the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        symbols = self._by_list(text) if len(text) <= PLAIN else self._by_heap(text)
        out: list[int] = []
        for s in symbols:
            found = self.ids.get(s)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return tuple(out)

    def _by_list(self, text: str) -> list[str]:
        """The agenda as the ranks of all adjacent pairs: its best entry is the first least one."""
        get, none, symbols = self.rank.get, math.inf, list(text)
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _by_heap(self, text: str) -> list[str]:
        rank = self.rank
        symbols: list[str] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, len(pair)))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            # A pair is stale when one of its sides was merged since it was noted.
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                pair = symbols[i] + symbols[k]
                if pair in rank:
                    heapq.heappush(agenda, (rank[pair], i, len(pair)))
            h = left[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in rank:
                    heapq.heappush(agenda, (rank[pair], h, len(pair)))
        return [s for s in symbols if s]

    def parts(self, text: str) -> list[str]:
        """The segments of a text, after the model's own character rules: the blank sign replaces blanks
        and leads the text."""
        normal = self.library.normalize(text)
        # Signs that stand before punctuation in some piece would make the finer cut unproven.
        return (self.fine if self.joined.isdisjoint(normal) else self.cut)(normal)

    def encode(self, text: str) -> list[int]:
        """Numbers of the pieces, without begin or end."""
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, self.parts(text))))

    def as_library(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library gives these ids.

        The library encodes every segment that was worked out since the last call, between
        signs that no piece holds next to another sign. Texts are sequences of checked segments. A vocabulary
        without such a sign has its whole texts encoded.
        """
        if not self.lone:
            return [a == b for a, b in zip(ids, self.library.encode(texts, num_threads=1))]
        sign = self.lone[0]
        apart = self.ids.get(sign, self.bytes.get(ord(sign), self.unk))
        parts = [p for p in self.known.unchecked if p not in self.lone]
        got, at = self.library.encode(sign + sign.join(parts) + sign, num_threads=1), 0
        at = got.index(apart) + 1
        for part in parts:
            end = got.index(apart, at)
            if tuple(got[at:end]) != self.known.unchecked[part]:
                self.wrong.add(part)
            at = end + 1
        self.known.unchecked.clear()
        if not self.wrong:
            return [True] * len(texts)
        return [self.wrong.isdisjoint(self.parts(t)) for t in texts]

    def decode(self, ids: list[int]) -> str:
        """The text of piece numbers; bytes that are no UTF-8 become replacement characters."""
        byte_of, plain = self.byte_of, self.plain
        if byte_of.keys().isdisjoint(ids):
            text = "".join([plain[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run and i not in self.silent:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(plain[i])
            out.append(_utf8(bytes(run)))
            text = "".join(out)
        first = next((i for i in ids if i not in self.silent), None)
        # The blank that the normaliser put before the text goes again.
        return text[1:] if first is not None and self.pieces[first].startswith(BLANK) else text


def _utf8(run: bytes) -> str:
    """Each byte that starts no whole character is one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def agenda_of(path: str) -> Agenda:
    """One vocabulary for each worker process, with what it remembers."""
    return Agenda(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, add_end: bool = True) -> DataFrame:
    """Adds `ids`, `decoded` (from the ids) and `as_library`; input columns of these names give way.

    The ids come from the agenda. For each Arrow batch the sentencepiece library encodes the segments that
    are new in it and decodes all ids; `as_library` tells whether both agree with the agenda.

    A null or empty text has the end id alone and decodes to ''; rows that repeat stay; an empty
    table gives an empty result. `path` names a merge-type model file that every executor reads.
    """
    docs = without(docs, OUT)
    path = path or model_path()
    names = docs.columns

    def make():
        agenda = agenda_of(path)
        library = agenda.library
        end = [agenda.eos] if add_end else []

        def apply(rows: dict[str, list]) -> dict[str, list]:
            texts = [t or "" for t in rows["text"]]
            ids = [agenda.encode(t) for t in texts]
            checked = agenda.as_library(texts, ids)
            ids = [i + end for i in ids]
            decoded = [agenda.decode(i) for i in ids]
            same = [a and b == c for a, b, c in zip(checked, decoded, library.decode(ids, num_threads=1))]
            return {n: rows[n] for n in names} | {"ids": ids, "decoded": decoded, "as_library": same}

        return apply

    schema = T.StructType(list(docs.schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string").add("as_library", "boolean")
    return arrow_map(docs, schema, make, rows=100)


def decode_documents(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the column `ids` (null: null)."""
    rows = without(rows, ["decoded"])
    path = path or model_path()
    names = rows.columns

    def make():
        agenda = agenda_of(path)

        def apply(part: dict[str, list]) -> dict[str, list]:
            decoded = [None if i is None else agenda.decode(i) for i in part[ids]]
            return {n: part[n] for n in names} | {"decoded": decoded}

        return apply

    schema = T.StructType(list(rows.schema.fields)).add("decoded", "string")
    return arrow_map(rows, schema, make, rows=100)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and decoded text; an empty table gives no rows, and a text without pieces
    has the digests of its end id and of the empty string."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "as_library",
    )
