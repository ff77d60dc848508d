"""Transcript analytics: tool rounds, windows, compaction, memory, artifacts.

A `messages` table has (session, seq, id, role, kind, content, tool_calls,
tool_call_id, tool_name, artifact_id); `seq` is an integer that orders a session.
Nothing here holds a whole session in one task: running values go through
`running`, last-n selections through ranked cuts, everything else through
aggregates with partial results and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import labels, text
from siftlake.operators.lines import ranked
from siftlake.operators.running import running
from siftlake.session import written_table

KEY = ["session"]
HIDDEN = [dims.BOUNDARY_KIND, dims.MICROCOMPACT_KIND]


def has_calls() -> Column:
    return F.coalesce(F.size("tool_calls"), F.lit(0)) > 0


def is_tool() -> Column:
    return F.col("role") == "tool"


# ---- sizes ----


def message_bytes() -> Column:
    """Bytes of the content plus of every call's name and arguments."""
    calls = F.aggregate(
        "tool_calls",
        F.lit(0),
        lambda n, c: n + F.octet_length(c["name"]) + F.octet_length(c["arguments"]),
    )
    return F.coalesce(F.octet_length("content"), F.lit(0)) + F.coalesce(calls, F.lit(0))


def context_bytes(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*KEY).agg(F.sum(message_bytes()).alias("bytes"), F.count("*").alias("messages"))


def tail_summary(messages: DataFrame, entries: int = 4) -> DataFrame:
    """`role=NB` of the last messages of every session, oldest first."""
    last = ranked(messages, [F.desc("seq")], KEY, entries).select("session", "seq", "role", message_bytes().alias("b"))
    shown = F.concat("role", F.lit("="), "b", F.lit("B"))
    return last.groupBy(*KEY).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", shown.alias("shown")))), lambda r: r["shown"]),
            ", ",
        ).alias("tail")
    )


def limit_verdict(
    messages: DataFrame,
    soft: int = dims.SOFT_LIMIT_BYTES,
    hard: int = dims.HARD_LIMIT_BYTES,
    cut: int = dims.SOFT_TRUNCATE_BYTES,
) -> DataFrame:
    """compact above the hard limit; above the soft limit the last tool output is cut and rechecked."""
    mark = len(dims.SOFT_CUT_MARK.encode())
    last_bytes = F.max_by(F.when(is_tool(), F.octet_length("content")), "seq")
    sizes = messages.groupBy(*KEY).agg(F.sum(message_bytes()).alias("bytes"), last_bytes.alias("last_tool_bytes"))
    saved = F.when(F.col("last_tool_bytes") > cut, F.col("last_tool_bytes") - cut - mark).otherwise(0)
    after = F.when((F.col("bytes") > soft) & (F.col("bytes") <= hard), F.col("bytes") - F.coalesce(saved, F.lit(0)))
    sized = sizes.withColumn("bytes_after", F.coalesce(after, F.col("bytes")))
    return sized.select(
        "session",
        "bytes",
        "bytes_after",
        F.when((F.col("bytes") > hard) | (F.col("bytes_after") > hard), "compact")
        .when(F.col("bytes") > soft, "truncate")
        .otherwise("ok")
        .alias("verdict"),
    )


# ---- rounds ----


def tool_rounds(messages: DataFrame) -> DataFrame:
    """Add `round`: number of messages with tool calls so far, minus one."""
    counted = running(messages, KEY, "seq", sums={"round": F.when(has_calls(), 1).otherwise(0)})
    return counted.withColumn("round", F.col("round") - 1)


def recent_rounds(rounds: DataFrame, keep: int = 2) -> DataFrame:
    """(session, round) of the last `keep` rounds that have tool messages."""
    used = rounds.filter(is_tool()).select("session", "round").distinct()
    return ranked(used, [F.desc("round")], KEY, keep if keep > 0 else 2)


def microcompact(
    messages: DataFrame, keep: int = 2, cleared: DataFrame | None = None, states: DataFrame | None = None
) -> DataFrame:
    """Older outputs of the read tools to be cleared, with placeholder and reclaimed bytes.

    Outputs without an artifact get a new one, numbered on from the session's highest: among the artifacts its
    messages name, or the stored counter of `states` (session, next_artifact_id) if that is higher.
    """
    rounds = tool_rounds(messages)
    old = rounds.filter(
        is_tool() & F.col("tool_name").isin(dims.COMPACTABLE_TOOLS) & (F.col("id") != dims.ROOT_PROMPT_ID)
    ).join(recent_rounds(rounds, keep), ["session", "round"], "left_anti")
    if cleared is not None:
        old = old.join(cleared.select("session", "id"), ["session", "id"], "left_anti")
    number = F.regexp_extract(F.coalesce("artifact_id", F.lit("")), r"^art-(\d+)$", 1).try_cast("long")
    used = messages.groupBy(*KEY).agg(F.coalesce(F.max(number), F.lit(0)).alias("used_no"))
    if states is not None:
        stored = states.groupBy(*KEY).agg(F.max("next_artifact_id").alias("stored_no"))
        used = used.join(stored, "session", "left").select(
            "session", F.greatest("used_no", F.coalesce("stored_no", F.lit(0))).alias("used_no")
        )
    fresh = F.coalesce("artifact_id", F.lit("")) == ""
    numbered = running(old, KEY, "seq", sums={"new_no": F.when(fresh, 1).otherwise(0)}).join(used, "session")
    new_id = F.format_string("art-%d", F.col("used_no") + F.col("new_no"))
    artifact = F.when(fresh, new_id).otherwise(F.col("artifact_id"))
    before, after = dims.CLEARED_PLACEHOLDER.split("%s")
    placeholder = F.concat(F.lit(before), artifact, F.lit(after))
    return numbered.select(
        "session",
        "seq",
        "id",
        "tool_name",
        artifact.alias("artifact_id"),
        placeholder.alias("placeholder"),
        (F.octet_length("content") - F.octet_length(placeholder)).alias("reclaimed_bytes"),
    )


def microcompact_totals(cleared: DataFrame) -> DataFrame:
    totals = cleared.groupBy(*KEY).agg(
        F.count("*").alias("cleared"), F.sum("reclaimed_bytes").alias("reclaimed_bytes")
    )
    return totals.withColumn(
        "event",
        F.format_string(
            dims.MICROCOMPACT_EVENT, "cleared", "reclaimed_bytes"
        ),
    )


def marks_of(messages: DataFrame) -> DataFrame:
    """One narrow row for each message, as a written table: all that rounds, windows and sizes need.

    (session, seq, id, role, tool, calls, answers, bytes) and `seg` (the non-tool messages so
    far: a segment is one of them and the tool messages after it), `n` (place in the session), `call_seq` (the
    last message with calls) and `total` (messages of the session).
    """
    ids = F.array_distinct(F.filter(F.transform("tool_calls", lambda c: c["id"]), lambda i: i != ""))
    slim = messages.select(
        "session",
        "seq",
        "id",
        "role",
        is_tool().alias("tool"),
        F.when(~is_tool(), ids).alias("calls"),
        F.when(is_tool() & (F.col("tool_call_id") != ""), F.col("tool_call_id")).alias("answers"),
        message_bytes().alias("bytes"),
        has_calls().alias("has_calls"),
    )
    slim = written_table(slim, "marks")
    numbered = running(
        slim,
        KEY,
        "seq",
        sums={"seg": F.when(F.col("tool"), 0).otherwise(1), "n": F.lit(1)},
        lasts={"call_seq": F.when(F.col("has_calls"), F.col("seq"))},
        totals={"total": F.lit(1)},
    )
    return written_table(numbered, "marks")


def _judged(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completeness by segment, and first answers to open calls (session, seg, seq)."""
    group = ["session", "seg"]
    wanted = marks.filter(~F.col("tool")).select(*group, F.explode("calls").alias("answers"))
    answers = (
        marks.filter(F.col("answers").isNotNull()).groupBy(*group, "answers").agg(F.min("seq").alias("seq"))
    )
    matched = wanted.join(answers, [*group, "answers"], "left")
    complete = matched.groupBy(*group).agg((F.count_if(F.col("seq").isNull()) == 0).alias("complete"))
    return complete, matched.filter(F.col("seq").isNotNull()).select(*group, "seq")


def _kept(marks: DataFrame) -> DataFrame:
    """(session, seq) of the messages that sanitising keeps."""
    complete, answers = _judged(marks)
    broken = complete.filter(~F.col("complete")).select("session", "seg")
    heads = marks.filter(~F.col("tool")).select("session", "seg", "seq")
    return heads.union(answers).join(broken, ["session", "seg"], "left_anti").select("session", "seq")


def sanitize_rounds(messages: DataFrame) -> DataFrame:
    """Messages without orphan tool outputs and without rounds that miss an answer.

    A tool message stays when it is the first answer to a call of its segment's head;
    a segment stays when all calls of its head are answered.
    """
    return messages.join(_kept(marks_of(messages)), ["session", "seq"], "left_semi")


def sanitize_counts(messages: DataFrame) -> DataFrame:
    """Per session: tool messages that match no open call, and incomplete rounds."""
    marks = marks_of(messages)
    complete, answers = _judged(marks)
    tools = marks.groupBy(*KEY).agg(F.count_if("tool").alias("tools"))
    matched = answers.groupBy(*KEY).agg(F.count("*").alias("matched"))
    rounds = complete.groupBy(*KEY).agg(F.count_if(~F.col("complete")).alias("dropped_rounds"))
    zero = F.lit(0).cast("long")
    return (
        tools.join(matched, "session", "left")
        .join(rounds, "session", "left")
        .select(
            "session",
            (F.col("tools") - F.coalesce("matched", zero)).alias("dropped_tools"),
            F.coalesce("dropped_rounds", zero).alias("dropped_rounds"),
        )
    )


# ---- windows from the end ----


def _cuts(marks: DataFrame, size: int) -> DataFrame:
    """(session, cut_seq, first_seq) where the last `size` messages start, moved back to their round's head."""
    at = marks.filter((F.col("total") > size) & (F.col("n") == F.col("total") - size + 1))
    cut = F.when(F.col("tool"), F.coalesce("call_seq", "seq")).otherwise(F.col("seq"))
    first = marks.filter("n = 1").select("session", F.col("seq").alias("first_seq"))
    return at.select("session", cut.alias("cut_seq")).join(first, "session")


def _in_tail(rows: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    if size <= 0:
        return rows.withColumn("in_tail", F.lit(False))
    cuts = _cuts(marks, size).filter(F.col("cut_seq") > F.col("first_seq")).select("session", "cut_seq")
    return rows.join(cuts, "session", "left").select(
        *rows.columns, F.coalesce(F.col("seq") >= F.col("cut_seq"), F.lit(False)).alias("in_tail")
    )


def tail_split(messages: DataFrame, size: int = 4) -> DataFrame:
    """Add `in_tail`. Short sessions and cuts at the very start have no tail."""
    return _in_tail(messages, marks_of(messages), size)


def compression_window(messages: DataFrame, size: int = 12) -> DataFrame:
    """The last `size` messages, sanitised; the sanitised whole history where that drops anything.

    Rounds are judged segment by segment and a window starts at a segment, so
    sanitising the window is the same as cutting the sanitised history.
    """
    marks = marks_of(messages)
    kept = _kept(marks).withColumn("kept", F.lit(True))
    placed = marks.select("session", "seq").join(kept, ["session", "seq"], "left")
    inside = F.lit(True)
    if size > 0:
        placed = placed.join(_cuts(marks, size).select("session", "cut_seq"), "session", "left")
        inside = F.coalesce(F.col("seq") >= F.col("cut_seq"), F.lit(True))
    placed = placed.withColumn("inside", inside)
    whole = placed.groupBy(*KEY).agg(
        (F.count_if(F.col("inside") & F.col("kept").isNull()) > 0).alias("full_history")
    )
    chosen = (
        placed.filter(F.col("kept"))
        .join(whole, "session")
        .filter(F.col("inside") | F.col("full_history"))
        .select("session", "seq", "full_history")
    )
    return messages.join(chosen, ["session", "seq"]).select(*messages.columns, "full_history")


# ---- compaction ----


def active_messages(messages: DataFrame, states: DataFrame) -> DataFrame:
    """Without a boundary everything; with one its preserved segment and what follows it.

    The state (session, active_boundary_id) names the boundary message, whose `boundary` holds the first and
    last id of the segment.
    """
    active = states.filter(F.coalesce("active_boundary_id", F.lit("")) != "").select(
        "session", F.col("active_boundary_id").alias("id")
    )
    found = messages.select("session", "id", "seq", "boundary").join(active, ["session", "id"])
    bounds = found.groupBy("session").agg(F.min(F.struct("seq", "boundary.head_id", "boundary.tail_id")).alias("b"))
    bounds = bounds.select("session", F.col("b.seq").alias("boundary_seq"), "b.head_id", "b.tail_id")
    ends = (
        messages.select("session", "id", "seq")
        .join(bounds, "session")
        .groupBy("session")
        .agg(
            F.min("boundary_seq").alias("boundary_seq"),
            F.min(F.when(F.col("id") == F.col("head_id"), F.col("seq"))).alias("head_seq"),
            F.min(F.when(F.col("id") == F.col("tail_id"), F.col("seq"))).alias("tail_seq"),
        )
    )
    seq, boundary = F.col("seq"), F.col("boundary_seq")
    kept = boundary.isNull() | (seq > boundary) | F.coalesce(seq.between(F.col("head_seq"), F.col("tail_seq")), F.lit(False))
    return messages.join(ends, "session", "left").filter(kept).select(*messages.columns)


def chat_view(active: DataFrame, cleared: DataFrame | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """What the model sees: no boundary or microcompact messages, cleared contents replaced.

    With `prompts` (session, prompt) each session starts with its prompt as the root entry, and a first user message
    that repeats it is left out.
    """
    shown = active.filter(~F.col("kind").isin(HIDDEN))
    columns = shown.columns
    if cleared is not None:
        marks = cleared.select("session", "id", "placeholder")
        shown = (
            shown.join(marks, ["session", "id"], "left")
            .withColumn("content", F.coalesce("placeholder", "content"))
            .select(*columns)
        )
    if prompts is None:
        return shown
    prompts = prompts.select("session", "prompt")
    again = (
        (F.coalesce("parent_id", F.lit("")) == "") & (F.col("role") == "user") & F.col("content").eqNullSafe(F.col("prompt"))
    )
    rest = shown.join(prompts, "session", "left").filter(~again).select(*columns)
    root = prompts.select(
        "session",
        F.lit(-1).cast("long").alias("seq"),
        F.lit(dims.ROOT_PROMPT_ID).alias("id"),
        F.lit("user").alias("role"),
        F.lit("normal").alias("kind"),
        F.col("prompt").alias("content"),
    )
    return root.unionByName(rest, allowMissingColumns=True).select(*columns)


def preserved_segment(kept: DataFrame) -> DataFrame:
    """First, last but one and last id of the kept messages, the root prompt left out."""
    usable = kept.filter(F.col("id") != dims.ROOT_PROMPT_ID)
    first = usable.groupBy(*KEY).agg(F.min_by("id", "seq").alias("head_id"))
    last_two = ranked(usable.select("session", "seq", "id"), [F.desc("seq")], KEY, 2)
    ends = last_two.groupBy(*KEY).agg(
        F.max_by("id", "seq").alias("tail_id"),
        F.when(F.count("*") > 1, F.min_by("id", "seq")).otherwise("").alias("anchor_id"),
    )
    return first.join(ends, "session")


def compaction_boundary(messages: DataFrame, size: int = 4, summaries: DataFrame | None = None) -> DataFrame:
    """Boundary rows: source, bytes before and after, number of summarised messages, preserved segment.

    `messages` is the chat view. `summaries` (session, summary_bytes) has the size of what is put in place of
    the summarised messages; `post_bytes` adds it to the kept messages. All numbers come from one narrow
    table, so the messages are read once.
    """
    marks = marks_of(messages.filter(~F.col("kind").isin(HIDDEN)))
    split = _in_tail(marks, marks, size)
    safe = marks.join(_kept(marks), ["session", "seq"], "left_semi")
    pre = safe.groupBy(*KEY).agg(F.sum("bytes").alias("pre_bytes"))
    counts = split.groupBy(*KEY).agg(
        F.count_if(~F.col("in_tail")).alias("summarized_message_count"),
        F.sum(F.when(F.col("in_tail"), F.col("bytes")).otherwise(0)).alias("kept_bytes"),
    )
    added = F.lit(0)
    if summaries is not None:
        counts = counts.join(summaries.select("session", "summary_bytes"), "session", "left")
        added = F.coalesce("summary_bytes", F.lit(0))
    counts = counts.select(
        "session",
        F.lit("auto").alias("source"),
        "summarized_message_count",
        "kept_bytes",
        (F.col("kept_bytes") + added).alias("post_bytes"),
    )
    segment = preserved_segment(split.filter("in_tail"))
    return counts.join(pre, "session", "left").join(segment, "session", "left").fillna(
        "", ["head_id", "anchor_id", "tail_id"]
    )


# ---- memory ----


def _after_cursor(messages: DataFrame, states: DataFrame) -> DataFrame:
    """Messages with the place of the memory cursor in `cursor_seq`, null when it is unknown."""
    ids = states.filter(F.col("last_memory_message_id").isNotNull()).select(
        "session", F.col("last_memory_message_id").alias("id")
    )
    cursor = (
        messages.select("session", "id", "seq")
        .join(ids, ["session", "id"])
        .groupBy("session")
        .agg(F.min("seq").alias("cursor_seq"))
    )
    return messages.join(cursor, "session", "left")


def memory_tail(messages: DataFrame, states: DataFrame, size: int = 4) -> DataFrame:
    """Messages after the memory cursor; where there is none the tail of the session.

    Only sessions whose `memory_text` is not blank have a memory to go on from.
    """
    known = states.filter(~text.blank(F.coalesce("memory_text", F.lit("")))).select(
        "session", "last_memory_message_id"
    )
    own = messages.join(known.select("session"), "session", "left_semi")
    placed = _after_cursor(own, known)
    after = placed.filter(F.col("seq") > F.col("cursor_seq")).select(*messages.columns)
    unknown = placed.filter(F.col("cursor_seq").isNull()).select(*messages.columns)
    return after.unionByName(tail_split(unknown, size).filter("in_tail").drop("in_tail"))


def memory_delta(
    messages: DataFrame,
    states: DataFrame,
    min_growth: int = dims.MEMORY_MIN_GROWTH_BYTES,
    min_calls: int = dims.MEMORY_MIN_TOOL_CALLS,
    now: Column | None = None,
    cooldown_seconds: int = 0,
) -> DataFrame:
    """Growth since the memory cursor: bytes, tool calls, last id, and whether it fires.

    With `now`, a session whose last memory updates failed does not fire for `cooldown_seconds` after
    the last failure.
    """
    placed = _after_cursor(messages, states)
    pending = placed.filter(
        (F.col("cursor_seq").isNull() | (F.col("seq") > F.col("cursor_seq"))) & ~F.col("kind").isin(HIDDEN)
    )
    grown = pending.groupBy(*KEY).agg(
        F.sum(F.octet_length("content")).alias("growth_bytes"),
        F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("tool_calls"),
        F.max_by("id", "seq").alias("last_id"),
    )
    fires = (F.col("growth_bytes") >= min_growth) & (F.col("tool_calls") >= min_calls)
    if now is not None:
        failed = F.when(F.col("consecutive_memory_failures") > 0, F.col("last_memory_failure_at"))
        until = states.groupBy(*KEY).agg(F.max(failed).alias("_until")).withColumn(
            "_until", F.col("_until") + F.make_dt_interval(secs=F.lit(cooldown_seconds))
        )
        grown = grown.join(until, "session", "left")
        fires = fires & ~F.coalesce(F.col("_until") > now, F.lit(False))
    return grown.withColumn("fires", fires).drop("_until")


def transcript_lines(messages: DataFrame, max_bytes: int) -> DataFrame:
    """Rendered lines up to the byte budget; the line that passes it is cut (call lines are dropped)."""
    shown = messages.filter(~F.col("kind").isin(HIDDEN))
    name = F.coalesce("tool_name", F.lit(""))
    role = F.when(name == "", F.col("role")).otherwise(F.concat("role", F.lit(":"), name))
    head = F.concat(F.lit("["), role, F.lit("] "), text.trim_all(F.coalesce("content", F.lit(""))), F.lit("\n"))
    calls = F.transform(
        "tool_calls", lambda c: F.concat(F.lit("[assistant:tool_call] "), c["name"], F.lit(" "), c["arguments"], F.lit("\n"))
    )
    rows = shown.select("session", "seq", F.concat(F.array(head), F.coalesce(calls, F.array())).alias("parts"))
    own = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p))
    sized = running(rows.withColumn("own_bytes", own), KEY, "seq", sums={"upto": F.col("own_bytes")}).filter(
        F.col("upto") - F.col("own_bytes") <= max_bytes
    )

    def before(i: Column) -> Column:
        return F.aggregate(
            F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)
        )

    placed = F.transform(
        "parts",
        lambda p, i: F.struct(
            i.alias("part"), p.alias("line"), (F.col("upto") - F.col("own_bytes") + before(i)).alias("start")
        ),
    )
    lines = sized.select("session", "seq", F.explode(placed).alias("z")).select("session", "seq", "z.*")
    room = F.greatest(F.lit(max_bytes) - F.col("start"), F.lit(0)).cast("int")
    over = F.col("start") + F.octet_length("line") > max_bytes
    cut = F.when(F.col("part") == 0, F.concat(text.cut_bytes("line", room), F.lit("\n"), F.lit(dims.TRANSCRIPT_CUT_MARK)))
    return lines.filter(F.col("start") <= max_bytes).select(
        "session",
        "seq",
        "part",
        F.when(over, F.coalesce(cut, F.lit(dims.TRANSCRIPT_CUT_MARK))).otherwise(F.col("line")).alias("line"),
        over.alias("cut"),
    )


def transcript_text(messages: DataFrame, max_bytes: int) -> DataFrame:
    """One text per session; the budget bounds what is collected."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "part", "line")))
    joined = F.array_join(F.transform(ordered, lambda r: r["line"]), "")
    return transcript_lines(messages, max_bytes).groupBy(*KEY).agg(text.trim_all(joined).alias("transcript"))


# ---- artifacts ----


def capture_artifacts(messages: DataFrame, max_bytes: int = dims.ARTIFACT_MAX_BYTES) -> DataFrame:
    """Tool outputs as artifacts: `ev-n` for file reads, `art-n` otherwise, cut at the size limit."""
    tools = messages.filter(is_tool())
    read = F.col("tool_name") == "read_file"
    numbered = running(
        tools, KEY, "seq", sums={"reads": F.when(read, 1).otherwise(0), "others": F.when(read, 0).otherwise(1)}
    )
    return numbered.select(
        "session",
        "seq",
        F.when(read, F.format_string("ev-%d", "reads")).otherwise(F.format_string("art-%d", "others")).alias("id"),
        F.when(read, "read_file").otherwise("tool_output").alias("type"),
        "tool_name",
        F.octet_length("content").alias("original_bytes"),
        (F.octet_length("content") > max_bytes).alias("truncated"),
        text.cut_bytes("content", max_bytes, dims.ARTIFACT_CUT_MARK).alias("content"),
    )


def artifact_line() -> Column:
    """Index line of an artifact; expects path, start_line and end_line, which may be null."""
    label = F.coalesce(F.nullif("path", F.lit("")), F.nullif("type", F.lit("")), F.nullif("tool_name", F.lit("")), F.lit("artifact"))
    line = F.concat(
        F.lit("- "), "id", F.lit(" | "), label, F.lit(" | "),
        labels.line_range_label("start_line", "end_line", "range unknown"), F.lit(" | "), "original_bytes", F.lit(" bytes"),
    )
    return F.when(F.col("truncated"), F.concat(line, F.lit(" | truncated"))).otherwise(line)


def recent_artifacts(artifacts: DataFrame, limit: int = 8) -> DataFrame:
    """Index of the last artifacts of every session."""
    last = ranked(artifacts.withColumn("line", artifact_line()), [F.desc("seq")], KEY, limit)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return last.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("index"))


def artifact_lookup(messages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts the messages refer to, with a header; `found` tells whether there is one."""
    wanted = messages.filter(F.coalesce("artifact_id", F.lit("")) != "").select("session", "seq", "artifact_id")
    known = artifacts.select(
        "session", F.col("id").alias("artifact_id"), "type", "tool_name", "original_bytes", "truncated", "content"
    )
    joined = wanted.join(known, ["session", "artifact_id"], "left")
    header = F.concat(
        F.lit("ARTIFACT "), "artifact_id", F.lit("\nType: "), "type", F.lit("\nTool: "), "tool_name",
        F.lit("\nOriginal Bytes: "), "original_bytes", F.lit("\nTruncated: "), F.col("truncated").cast("string"),
    )
    return joined.select(
        "session", "seq", "artifact_id", F.col("type").isNotNull().alias("found"), header.alias("header"), "content"
    )


def truncate_tool_output(messages: DataFrame, max_bytes: int = dims.TOOL_OUTPUT_BYTES) -> DataFrame:
    """Tool outputs cut as they are appended."""
    cut = text.cut_bytes("content", max_bytes, dims.TOOL_OUTPUT_CUT_MARK)
    return messages.withColumn("content", F.when(is_tool(), cut).otherwise(F.col("content")))


def soft_truncate_last(messages: DataFrame, max_bytes: int = dims.SOFT_TRUNCATE_BYTES) -> DataFrame:
    """Last message of every session when it is a too long tool output, with its new content."""
    last = messages.groupBy(*KEY).agg(F.max("seq").alias("seq"))
    rows = messages.join(last, ["session", "seq"]).filter(is_tool() & (F.octet_length("content") > max_bytes))
    return rows.select(
        "session",
        "seq",
        "id",
        F.octet_length("content").alias("original_bytes"),
        text.cut_bytes("content", max_bytes, dims.SOFT_CUT_MARK).alias("content"),
        (F.coalesce("artifact_id", F.lit("")) == "").alias("needs_artifact"),
    )


def tool_call_rows(messages: DataFrame) -> DataFrame:
    """Tool calls as rows: (session, seq, call_no, name, arguments)."""
    calls = messages.select("session", "seq", F.posexplode("tool_calls").alias("call_no", "c"))
    return calls.select("session", "seq", "call_no", "c.name", "c.arguments")


def repeated_tool_calls(messages: DataFrame) -> DataFrame:
    """Calls whose name and arguments were used before in the session, with the first use."""
    calls = tool_call_rows(messages)
    first = calls.groupBy("session", "name", "arguments").agg(F.min(F.struct("seq", "call_no")).alias("first"))
    return (
        calls.join(first, ["session", "name", "arguments"])
        .filter(F.struct("seq", "call_no") > F.col("first"))
        .select("session", "seq", "call_no", "name", "arguments", F.col("first.seq").alias("first_seq"))
    )


def latest_resumable_stage(states: DataFrame) -> DataFrame:
    """Per task the newest paused, running or failed state; ties go to the larger stage name."""
    return resumable_states(states).groupBy("task_id").agg(
        F.max_by("stage", F.struct("updated_at", "stage")).alias("stage")
    )


def resumable_states(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status").isin("paused", "running", "failed"))
