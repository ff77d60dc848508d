"""Finding tables from stage documents: parsing, exploding, filtering, checking.

A `stages` table has (stage_id, task_id, name, status, result, output_json,
created_at, updated_at); one row is one stage document. Findings are rows
(stage_id, task_id, stage, pos, item) with `item` a variant object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import jsontext, labels, text

KNOWN_STAGES = [key for key, _ in dims.STAGES]
ROUTE_TEXTS = jsontext.texts(["method", "path"], objects=False)


# ---- parsing ----


def parse_findings(docs: DataFrame, read: jsontext.Reader = jsontext.VARIANTS) -> DataFrame:
    """Add state (array / raw / none / too_large), items (array<variant>) and raw_text.

    An empty array is structured. Text is raw when neither column holds an
    array; none means there is no payload at all. Texts may be of any length that a row holds: beyond the variant limit
    elements are read one by one. Only an array with a single element beyond that limit is `too_large`. With another
    reader the items are of its type, as `jsontext.texts` gives them.
    """
    # One expression bound step by step: a filter on its state costs one parse, not one per use.
    def unless_blank(column: str, *empty: str) -> Column:
        return jsontext.let(
            jsontext.trim_long(column), lambda t: F.when(~t.isin("", *empty), t)
        )

    sizes = [F.coalesce(jsontext.over_limit(F.col(c)), F.lit(False)) for c in ("result", "output_json")]
    long = [jsontext.has_long_element(jsontext.trim_long(c)) for c in ("output_json", "result")]
    over = F.when(sizes[0] | sizes[1], long[0] | long[1]).otherwise(False)
    raw = F.coalesce(unless_blank("result"), unless_blank("output_json", "{}", "null"))

    def described(items: Column) -> Column:
        def named(raw_text: Column) -> Column:
            state = (
                F.when(items.isNotNull(), "array")
                .when(raw_text["over"], "too_large")
                .when(raw_text["said"].isNotNull(), "raw")
                .otherwise("none")
            )
            text_left = F.when(~raw_text["over"], raw_text["said"])
            return F.struct(state.alias("state"), items.alias("items"), text_left.alias("raw_text"))

        said = F.struct(F.when(items.isNull(), raw).alias("said"), (items.isNull() & over).alias("over"))
        return jsontext.let(said, named)

    recovered = F.coalesce(jsontext.decode_array("output_json", read), jsontext.block_items("result", read))
    parsed = jsontext.let(read.finish(recovered), described)
    return (
        docs.withColumn("_parsed", parsed)
        .withColumns({name: F.col(f"_parsed.{name}") for name in ("state", "items", "raw_text")})
        .drop("_parsed")
    )


def where_parsed(docs: DataFrame, condition: Column) -> DataFrame:
    """Filter on parse results without parsing again.

    A plain filter would be pushed below the projection that parses, and the
    parse would run in both places; a filter on a generated column stays put.
    """
    kept = F.explode_outer(F.when(condition, F.array(F.lit(True))))
    return docs.withColumn("_kept", kept).filter(F.col("_kept")).drop("_kept")


def ui_items(docs: DataFrame, read: jsontext.Reader = jsontext.ANY) -> DataFrame:
    """The user interface's reading: items or null, and whether there is any payload.

    It looks at `output_json` alone unless that is absent, and never turns an
    object into a list. With another reader the items are of its type, which must take elements of any kind.
    """

    # Each step is a column, so that texts are trimmed once and the steps are compiled.
    def edges(t: Column) -> Column:
        return F.when(text.spaced(t), text.trim_all(t)).otherwise(t)

    absent = F.col("_output").isin("", "null")
    source = F.coalesce("_result", F.when(~F.col("_output").startswith("{"), F.col("_output")))
    items = read.finish(jsontext.result_items(F.col("_array"), read))
    return (
        docs.withColumn("_output", F.trim(F.coalesce("output_json", F.lit(""))))
        .withColumn("_output", edges(F.col("_output")))
        .withColumn("_result", F.when(absent, F.trim(F.coalesce("result", F.lit("")))))
        .withColumn("_result", edges(F.col("_result")))
        .withColumn("_source", source)
        .withColumn("_array", jsontext.result_array_text(F.col("_source")))
        .withColumn("items", items)
        .withColumn("has_payload", F.when(absent, F.col("_result") != "").otherwise(F.col("_output") != "{}"))
        .drop("_output", "_result", "_source", "_array")
    )


def explode_findings(parsed: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per array element with its position; optionally a row for documents without any.

    The outer form keeps the parse out of the filter Spark would infer from an
    inner explode, so that each document is parsed once.
    """
    kept = [c for c in parsed.columns if c != "items"]
    rows = parsed.select(*kept, F.posexplode_outer("items").alias("pos", "item"))
    return rows if keep_empty else rows.filter(F.col("pos").isNotNull())


def finding_columns(findings: DataFrame) -> DataFrame:
    """Add the text columns joins and groupings use; unused ones are pruned by the optimizer."""
    item = F.col("item")
    out = {name: jsontext.text_at(item, name) for name in (
        "type", "subtype", "severity", "reviewed_severity", "verification_reason", "origin", "description",
    )}
    for name in ("file", "line", "function"):
        out[name] = jsontext.text_at(item, f"location.{name}")
    for name in ("method", "path", "parameter"):
        out[name] = jsontext.text_at(item, f"trigger.{name}")
    status = labels.verification_status(jsontext.text_at(item, "verification_status"))
    return findings.withColumns({**out, "verification": status}).withColumn(
        "effective", labels.effective_severity("severity", "reviewed_severity")
    )


def stage_findings(stages: DataFrame) -> DataFrame:
    """Findings of all stage documents, with text columns."""
    docs = stages.select(
        "stage_id", "task_id", F.col("name").alias("stage"), "status", "result", "output_json"
    )
    return finding_columns(explode_findings(parse_findings(docs).drop("raw_text", "result", "output_json")))


def field_texts(stages: DataFrame) -> DataFrame:
    """(stage_id, key, value): every field of all findings in its printed form."""
    docs = parse_findings(stages.select("stage_id", "result", "output_json"), jsontext.FIELDS)
    return explode_findings(docs.select("stage_id", "items")).select("stage_id", F.explode("item").alias("key", "value"))


# ---- predicates ----


def active_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("verification") != "rejected")


def rejected_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("verification") == "rejected")


def completed_known_stages(stages: DataFrame) -> DataFrame:
    return stages.filter(labels.is_completed("status") & F.col("name").isin(KNOWN_STAGES))


def exportable_stages(stages: DataFrame) -> DataFrame:
    """Completed stages with an array or a text to show."""
    return where_parsed(parse_findings(stages.filter(labels.is_completed("status"))), F.col("state") != "none")


def exportable_stages_ui(stages: DataFrame) -> DataFrame:
    """The user interface's rule; its completed test is exact."""
    seen = ui_items(stages.filter(F.col("status") == "completed"))
    return where_parsed(seen, F.col("items").isNotNull() | F.col("has_payload"))


def stage_actions(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """What may be done with each of the ten stages of each task, `init` among them.

    Nothing starts while the task runs; a gap check needs a completed structured
    result, a revalidation also at least one finding; resuming needs a paused or
    failed stage. A stage that has not run may only be run. The route inventory of `init` lives on
    the task. On repeated names the first document counts.
    """
    facts = parse_findings(stages.filter(F.col("name").isin(KNOWN_STAGES))).select(
        "task_id",
        F.col("name").alias("stage"),
        F.struct(
            "created_at",
            "stage_id",
            F.lower("status").alias("status"),
            (F.col("state") == "array").alias("structured"),
            F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        ).alias("own"),
    )
    # Only these small structs are aggregated, partly before the shuffle.
    first = facts.groupBy("task_id", "stage").agg(F.min("own").alias("own"))
    ten = F.array(*[F.lit(s) for s in ("init", *KNOWN_STAGES)])
    grid = parse_findings(tasks).select(
        "task_id",
        (F.col("status") != "running").alias("idle"),
        (F.col("state") == "array").alias("routes"),
        F.explode(ten).alias("stage"),
    )
    rows = grid.join(first, ["task_id", "stage"], "left")
    idle, init = F.col("idle"), F.col("stage") == "init"
    done = F.coalesce((F.col("own.status") == "completed") & F.col("own.structured"), F.lit(False))
    return rows.select(
        "task_id",
        "stage",
        F.col("own.stage_id").alias("stage_id"),
        idle.alias("can_run"),
        (idle & F.when(init, F.col("routes")).otherwise(done)).alias("can_gap_check"),
        (idle & done & (F.coalesce("own.n_items", F.lit(0)) > 0)).alias("can_revalidate"),
        (idle & F.coalesce(F.col("own.status").isin("paused", "failed"), F.lit(False))).alias("can_resume"),
        idle.alias("can_delete"),
    )


# ---- routes ----


def route_counts(tasks: DataFrame) -> DataFrame:
    """(task_id, route_count): length of the route inventory of every task."""
    return parse_findings(tasks).select(
        "task_id", F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).alias("route_count")
    )


def route_counts_ui(tasks: DataFrame) -> DataFrame:
    """The user interface counts only routes with a method and a path."""

    def named(item: Column) -> Column:
        return (jsontext.shown_at(item, "method") != "") & (jsontext.shown_at(item, "path") != "")

    counted = F.size(F.filter("items", named))
    return ui_items(tasks, ROUTE_TEXTS).select(
        "task_id", F.when(F.col("items").isNull(), 0).otherwise(counted).alias("route_count")
    )


# ---- repair inputs and checks ----


def raw_result_fallback(docs: DataFrame) -> DataFrame:
    """Text to repair: the result, else what follows the marker in the latest AI log entry."""
    marker = dims.LOG_AI_MARKER
    entries = F.filter("logs", lambda e: F.contains(e, F.lit(marker)))
    last = F.try_element_at(entries, F.lit(-1))
    said = F.substring(last, F.locate(marker, last) + len(marker), F.length(last))
    has_result = F.coalesce("result", F.lit("")) != ""
    return docs.withColumn("repair_text", F.when(has_result, F.col("result")).otherwise(said))


def latest_ai_text(logs: DataFrame, keys: list[str]) -> DataFrame:
    """The same rule over a tidy log table (keys, seq, entry): last AI entry per key."""
    marker = dims.LOG_AI_MARKER
    said = logs.filter(F.contains("entry", F.lit(marker)))
    after = F.substring("entry", F.locate(marker, F.col("entry")) + len(marker), F.length("entry"))
    return said.groupBy(*keys).agg(F.max_by(after, "seq").alias("repair_text"))


def repair_tool_args(value: Column | str) -> Column:
    """Tool arguments cut to their first `{` and last `}`."""
    body = text.trim_all(value)
    start, end = F.locate("{", body), jsontext.last_index(body, "}")
    from_start = F.when((start > 1), F.substring(body, start, F.length(body))).otherwise(body)
    stop = jsontext.last_index(from_start, "}")
    return F.when(end > 0, F.substring(from_start, F.lit(1), stop)).otherwise(from_start)


def schema_check(findings: DataFrame) -> DataFrame:
    """Violations (task_id, stage, stage_id, pos, field, rule) against the per-stage rules."""

    def broken(field: str, rule: str, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))

    item, stage = F.col("item"), F.col("stage")
    checks = [
        broken("type", "stage_type", (labels.stage_type(stage) != "") & (F.col("type") != labels.stage_type(stage)))
    ]
    for name, allowed in dims.ALLOWED_SUBTYPES.items():
        checks.append(broken("subtype", "allowed", (stage == name) & ~F.col("subtype").isin(allowed)))
    for name, field, allowed in dims.ALLOWED_VALUES:
        value = jsontext.text_at(item, field)
        checks.append(broken(field, "allowed", (stage == name) & ~value.isin(allowed)))
    for name, field in dims.ARRAY_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))
        is_array = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
        checks.append(broken(field, "array", (stage == name) & ~is_array))
    for name, field in dims.REQUIRED_FIELDS:
        checks.append(broken(field, "required", (stage == name) & text.blank(jsontext.text_at(item, field))))
    stored = (stage == "xss") & (F.col("subtype") == "Stored XSS")
    checks.append(broken("storage_point", "required", stored & text.blank(jsontext.text_at(item, "storage_point"))))
    return findings.select(
        "stage_id", "task_id", "stage", "pos", F.explode(F.array_compact(F.array(*checks))).alias("broken")
    ).select("stage_id", "task_id", "stage", "pos", "broken.field", "broken.rule")


def matches_expected_type(docs: DataFrame) -> DataFrame:
    """Per document: do the results look like this stage's results?

    Empty results match. Static scans need file, code and description on every
    item; other stages compare the first item's type.
    """

    def static_like(item: Column) -> Column:
        return (
            (jsontext.text_at(item, "location.file") != "")
            & F.try_variant_get(item, "$.vulnerable_code", "variant").isNotNull()
            & (jsontext.text_at(item, "description") != "")
        )

    items, stage = F.col("items"), F.col("stage")
    first_type = jsontext.text_at(F.get(items, F.lit(0)), "type")
    seen = ui_items(docs)
    return seen.withColumn(
        "matches",
        F.when(items.isNull() | (F.size(items) == 0), True)
        .when(stage == "static_scan", F.forall(items, static_like))
        .when(labels.stage_type(stage) == "", True)
        .otherwise(first_type == labels.stage_type(stage)),
    )
