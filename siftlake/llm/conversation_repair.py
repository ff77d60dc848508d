"""Conversation structure repair by lightest derivations.

Repair items are deduced in Knuth's way: an agenda of items ordered by (cost, size, audit), each finalised when it is
popped. Long conversations are cut into segments; a segment's lightest derivations from any state of the
role grammar to any other are joined at the end, so no conversation has to fit one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlake.llm.common import written

# Costs of the edits, and the grammar (s?(ua)+)? of role initials as state -> initial -> state.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
STATES = len(GRAMMAR)
#: Rows of a segment, at most.
SEGMENT = 1024

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
PIECE = (
    "conv_id long, part int, n long, low long, turns long, first_turn long, last_turn long, "
    "first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "costs array<long>, audits array<string>"
)
WHOLE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

Derivation = tuple[int, str]


def damage(convs: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that crc32 of `conv_id:turn` modulo 20 names.

    0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 sets its role to user. A null role,
    text, or part of the hashed name reads as one space; conv_id and turn themselves stay null.
    """
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    text = F.coalesce(F.col("text").cast("string"), space)
    rows = convs.withColumn("_fault", F.crc32(name.cast("binary")) % 20).where("_fault != 0")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(F.col("_fault") == 1, "")
        .when(F.col("_fault") == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.when(F.col("_fault") == 3, 2).otherwise(1).alias("_copies"),
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def lightest(rows: list[tuple[str, bool, int]], start: int, goal: bool = False) -> dict[int, Derivation]:
    """The lightest derivation over `rows` from state `start`, by end state.

    A row is (role initial, truncated, n): n = 0 is a row that may stay; n > 0 stands for n rows that must go. Axioms are
    the start, the edits of each row and the two inserts; a prefix of i rows in a state meets an edit of row i or an
    insert and gives a prefix in the next state, with added costs and joined audits. Items are popped in order of
    (cost, rows, audit): what a rule gives is never before what it takes, and a smaller
    argument gives a smaller result, so a popped item is final. `goal` ends with the first complete prefix.
    """
    end = len(rows)
    agenda: list[tuple] = [(0, 0, "", True, start)]
    for i, (initial, cut, n) in enumerate(rows):
        if n:
            agenda.append((DELETE * n, 1, "D" * n, False, (i, "")))
            continue
        extra = TRUNCATED if cut else 0
        agenda.append((DELETE, 1, "D", False, (i, "")))
        if initial in ("s", "u", "a"):
            agenda.append((extra, 1, "K", False, (i, initial)))
        for to in ROLES:
            if to != initial:
                agenda.append((REROLE + extra, 1, "R", False, (i, to)))
    heapq.heapify(agenda)
    prefixes: dict[tuple[int, int], Derivation] = {}
    edits: dict[tuple[int, str], Derivation] = {}
    push = heapq.heappush

    def meet(i: int, state: int, out: str) -> None:
        to = state if out == "" else GRAMMAR[state].get(out)
        if to is not None and (i + 1, to) not in prefixes:
            (c1, a1), (c2, a2) = prefixes[i, state], edits[i, out]
            push(agenda, (c1 + c2, i + 1, a1 + a2, True, (i + 1) * STATES + to))

    while agenda:
        cost, size, audit, is_prefix, item = heapq.heappop(agenda)
        if not is_prefix:
            if item in edits:
                continue
            edits[item] = cost, audit
            i, out = item
            for state in GRAMMAR:
                if (i, state) in prefixes:
                    meet(i, state, out)
            continue
        i, state = divmod(item, STATES)
        if (i, state) in prefixes:
            continue
        prefixes[i, state] = cost, audit
        if goal and i == end and state in FINAL:
            return {state: (cost, audit)}
        for out in ("", "s", "u", "a"):
            if (i, out) in edits:
                meet(i, state, out)
        for out in ROLES:
            to = GRAMMAR[state].get(out)
            if to is not None and (i, to) not in prefixes:
                push(agenda, (cost + INSERT, i, audit + "I", True, i * STATES + to))
    return {state: prefixes[end, state] for state in GRAMMAR if (end, state) in prefixes}


def joined(left: dict[int, dict[int, Derivation]], right: dict[int, dict[int, Derivation]]) -> dict[int, dict[int, Derivation]]:
    """Derivations over two neighbouring segments: the lightest over the states between them."""
    out: dict[int, dict[int, Derivation]] = {}
    for start, middle in left.items():
        best: dict[int, Derivation] = {}
        for state, (c1, a1) in middle.items():
            for end, (c2, a2) in right.get(state, {}).items():
                found = (c1 + c2, a1 + a2)
                if end not in best or found < best[end]:
                    best[end] = found
        out[start] = best
    return out


class _Piece:
    """What one task has of one conversation, in order."""

    def __init__(self, conv_id, whole_start: bool):
        self.conv_id = conv_id
        self.starts = [0] if whole_start else list(GRAMMAR)
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.first_turn = self.last_turn = self.first = self.last = None
        self.rows: list[tuple[str, bool, int]] = []
        self.folded: dict[int, dict[int, Derivation]] | None = None

    def add(self, turn, initial: str, copies: int, blank: bool, cut: bool, again: bool) -> None:
        if not copies:
            return
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            if self.first_turn is None:
                self.first_turn = self.low = turn
            self.last_turn = turn
        if self.n and (self.last + initial) not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # no initial may follow itself
        if not self.n:
            self.first = initial
        self.last = initial
        self.n += copies
        gone = copies
        if blank:
            self.blank += copies
        else:
            gone = copies if again else copies - 1
            self.duplicate += gone
            if not again:
                self.truncated += cut
                self.rows.append((initial, cut, 0))
        if gone:
            if self.rows and self.rows[-1][2]:
                gone += self.rows.pop()[2]
            self.rows.append(("", False, gone))
        if len(self.rows) >= SEGMENT:
            self.fold()

    def fold(self) -> None:
        """Replace the rows so far by their derivations; a run that may grow stays."""
        held = [self.rows.pop()] if self.rows and self.rows[-1][2] else []
        if not self.rows:
            self.rows = held
            return
        if self.folded is None:
            self.folded = {s: lightest(self.rows, s) for s in self.starts}
        else:
            middle = {m for ends in self.folded.values() for m in ends}
            self.folded = joined(self.folded, {s: lightest(self.rows, s) for s in sorted(middle)})
        self.rows = held

    def row(self, part: int, complete: bool) -> dict:
        if complete and self.folded is None and self.starts == [0]:
            self.folded = {0: lightest(self.rows, 0, goal=True)}
        else:
            rows, self.rows = self.rows, []
            last = {s: lightest(rows, s) for s in GRAMMAR} if self.folded else {s: lightest(rows, s) for s in self.starts}
            self.folded = joined(self.folded, last) if self.folded else last
        cells = [self.folded.get(s, {}).get(e) for s in GRAMMAR for e in GRAMMAR]
        return {
            "conv_id": self.conv_id, "part": part, "n": self.n, "low": self.low, "turns": self.turns,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "first": self.first, "last": self.last,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells],
        }


def _streamed(df: DataFrame, schema: str, make: Callable[[Iterator[tuple]], Iterator[dict]], size: int = 500) -> DataFrame:
    """`make` turns the rows of a partition, in order, into others; `size` of them are held at once."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make(_records(batches, size))
        while some := list(islice(rows, size)):
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return df.mapInArrow(run, kind)


def _records(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Rows of Arrow batches, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(*[c.to_pylist() for c in part.columns])


def _pieces(rows: Iterator[tuple]) -> Iterator[dict]:
    """One row for each conversation of a task."""
    piece, part, first = None, 0, True
    for conv_id, part, turn, initial, copies, blank, cut, again in rows:
        if piece is None or piece.conv_id != conv_id:
            if piece is not None:
                yield piece.row(part, complete=not first)
                first = False
            # Only the first conversation of a task can have begun in another one.
            piece = _Piece(conv_id, whole_start=piece is not None)
        piece.add(turn, initial, copies, blank, cut, again)
    if piece is not None:
        yield piece.row(part, complete=False)


class _Whole:
    """A conversation put together from its pieces, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.ends: dict[int, Derivation] = {0: (0, "")}
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.last_turn = self.last = None

    def add(self, p: dict) -> None:
        right: dict[int, dict[int, Derivation]] = {s: {} for s in GRAMMAR}
        for k, (cost, audit) in enumerate(zip(p["costs"], p["audits"])):
            if cost is not None:
                right[k // STATES][k % STATES] = cost, audit
        self.ends = joined({0: self.ends}, right)[0]
        if p["n"]:
            if self.n and (self.last + p["first"]) not in LEGAL:
                self.illegal += 1
            self.n, self.last = self.n + p["n"], p["last"]
        if p["low"] is not None:
            self.turns += p["turns"] - (self.last_turn == p["first_turn"])
            self.low = p["low"] if self.low is None else self.low
            self.last_turn = p["last_turn"]
        self.blank += p["blank"]
        self.duplicate += p["duplicate"]
        self.truncated += p["truncated"]
        self.illegal += p["illegal"]

    def row(self) -> dict:
        cost, audit = min(self.ends[s] for s in FINAL if s in self.ends)
        gaps = 0 if self.low is None else self.last_turn - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def _wholes(rows: Iterator[tuple]) -> Iterator[dict]:
    names = [c.split()[0] for c in PIECE.split(", ")]
    whole = None
    for row in rows:
        piece = dict(zip(names, row))
        if whole is None or whole.conv_id != piece["conv_id"]:
            if whole is not None:
                yield whole.row()
            whole = _Whole(piece["conv_id"])
        whole.add(piece)
    if whole is not None:
        yield whole.row()


def _ordered(convs: DataFrame) -> DataFrame:
    """Rows with what orders them: conversations by turn (nulls first), then role, then hash of the text."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    return convs.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_key"),
        text.alias("text"),
    )


def repair_plan(convs: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, its faults and the cheapest edits, in `REPORT` columns.

    `audit` has a letter for each row in order (K keep, R change the role, D delete) and each inserted row (I); together
    with the rows it says what the repaired conversation is. Costs and rules stand at the top of this
    module; among edits of equal cost the least audit wins.

    A row's fault is the first of: blank, duplicate (an earlier row has its role and text), truncated.
    Rows that share a turn go by role, then by hash of the text; rows equal in all are duplicates but for the first. Null
    roles and texts read as one space, null turns come first and count for no gap, a null conv_id is a conversation;
    an empty table gives an empty result. Other columns are not read.

    Only hashes and flags are shuffled here, equal rows as one row with a count, dealt out by ranges of the whole
    order: a conversation with a third of all rows is spread over a third of the tasks.
    """
    rows = _ordered(convs)
    blank = ~F.col("text").rlike(BLANK)
    narrow = rows.select("conv_id", "turn", "role", "_key", blank.alias("_blank"), (~F.col("text").rlike(ENDED)).alias("_cut"))
    same = narrow.groupBy("conv_id", "turn", "role", "_key").agg(
        F.count(F.lit(1)).alias("_copies"), F.first("_blank").alias("_blank"), F.first("_cut").alias("_cut")
    )
    same = written(same, "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (
        same.where("not _blank")
        .groupBy("conv_id", "role", "_key")
        .agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_key").alias("_k"), "_first")
    )
    found = same.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_key") == F.col("_k")),
        "left",
    ).withColumn("_again", F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(at))
    order = ["conv_id", "turn", "role", "_key"]
    found = written(found.select(*order, "_copies", "_blank", "_cut", "_again"), "repair-marked")
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(
        "conv_id", F.spark_partition_id().alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), "_copies", "_blank",
        "_cut", "_again",
    )
    pieces = written(_streamed(dealt, PIECE, _pieces, 2000), "repair-pieces")
    return _streamed(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part"), WHOLE, _wholes, 50)


def repaired_rows(convs: DataFrame, plan: DataFrame) -> DataFrame:
    """Repaired conversations: (conv_id, place, edit, role, text), `place` from 0.

    The rows of a conversation stand together in one partition, in order. They stream through with their audit in
    front; nothing but a batch and the audit is held.
    """
    rows = _ordered(convs).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_key", "text")
    audits = plan.select(
        "conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").cast("binary").alias("_key"), F.col("audit").alias("text"),
    )
    order = ["conv_id", "_kind", "turn", "role", "_key"]
    dealt = audits.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)

    def edit(rows: Iterator[tuple]) -> Iterator[dict]:
        conv_id, audit, at, place, state = None, "", 0, 0, 0

        def made(letter: str, role: str, text: str) -> dict:
            return {"conv_id": conv_id, "place": place, "edit": letter, "role": role, "text": text}

        def inserts() -> Iterator[dict]:
            nonlocal at, place, state
            while at < len(audit) and audit[at] == "I":
                to = "a" if state == 2 else "u"
                yield made("I", ROLES[to], "")
                at, place, state = at + 1, place + 1, GRAMMAR[state][to]

        for now, kind, role, text in rows:
            yield from inserts()
            if kind == 0:
                conv_id, audit, at, place, state = now, text, 0, 0, 0
                yield from inserts()
                continue
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES["a" if state == 2 else "u"]
            yield made(letter, role, text)
            place, state = place + 1, GRAMMAR[state][role[0]]
        yield from inserts()

    return _streamed(
        dealt.select("conv_id", "_kind", "role", "text"), "conv_id long, place long, edit string, role string, text string", edit
    )


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of `repaired_rows`: their `role:text`, joined by newlines.

    Follows its rows without a shuffle, as a hash over a text takes it in order.
    """

    def run(rows: Iterator[tuple]) -> Iterator[dict]:
        now = state = None
        for conv_id, place, role, text in rows:
            if place == 0:
                if state is not None:
                    yield {"conv_id": now, "repaired_sha256": state.hexdigest()}
                now, state = conv_id, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if state is not None:
            yield {"conv_id": now, "repaired_sha256": state.hexdigest()}

    return _streamed(repaired.select("conv_id", "place", "role", "text"), "conv_id long, repaired_sha256 string", run)


def repair_report(all_convs: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each conv_id of `all_convs`: the plan for its rows in `convs` and the hash of what it becomes.

    A conversation without rows there has zeros, an empty audit and the hash of the empty string.
    """
    plan = written(repair_plan(convs), "repair-plan")
    hashes = digests(repaired_rows(convs, plan)).withColumnRenamed("conv_id", "_h")
    plan = plan.withColumnRenamed("conv_id", "_p")
    ids = all_convs.select(F.col("conv_id").cast("long")).distinct()
    out = ids.join(plan, F.col("conv_id").eqNullSafe(F.col("_p")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT[:-1]]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
