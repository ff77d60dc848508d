"""Report tables of all tasks at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, VariantType

from siftlake import dims
from siftlake.functions import jsontext, labels, text
from siftlake.operators.findings import (
    KNOWN_STAGES,
    parse_findings,
    route_counts,
    route_counts_ui,
    ui_items,
    where_parsed,
)
from siftlake.operators.rollup import latest_ids, latest_stage_by_name, severity_counts
from siftlake.session import written_table

VARIANTS_TYPE = ArrayType(VariantType())
REPORT_KEYS = [key for key, _, _ in dims.REPORT_STAGES]


# What the findings, stages and overview of a report read of an element.
_PATHS = ["severity", "reviewed_severity", "verification_status", "verification_reason", "origin", "subtype", "description",
          "location.file", "location.line", "trigger.method", "trigger.path", "trigger.parameter"]
TEXTS = jsontext.texts(_PATHS)
# The same with the detail fields, and what these alone need.
FULL = jsontext.texts([*_PATHS, "component_name", "component_version"], skipped=dims.HEADER_FIELDS)
DETAILS = jsontext.texts(["verification_status", "component_name", "component_version"], skipped=dims.HEADER_FIELDS)
# What the user interface's overview reads of an element.
UI_TEXTS = jsontext.texts(
    ["severity", "reviewed_severity", "verification_status", "location.file", "trigger.method", "trigger.path"], objects=False
)


def report_documents(stages: DataFrame, read: jsontext.Reader = jsontext.VARIANTS) -> DataFrame:
    """Latest document per (task, report stage) that is completed and has a payload.

    Read with `TEXTS`, documents serve all tables but the detail fields, which take `DETAILS`; `FULL` serves all.
    Those few texts are far less than a document, so they are read before the latest are chosen, and no document is shuffled.
    """
    audit = stages.filter(F.col("name").isin(REPORT_KEYS))
    few = read is TEXTS
    done = (audit if few else latest_stage_by_name(audit)).filter(labels.is_completed("status"))
    parsed = where_parsed(parse_findings(done, read), F.col("state") != "none").select(
        "stage_id", "task_id", F.col("name").alias("stage"), "state", "items", "raw_text", "updated_at"
    )
    # An inner join with distinct ids, as a semi join would be moved below the reading.
    return parsed.join(latest_ids(audit).distinct(), "stage_id") if few else parsed


def _reader(documents: DataFrame) -> Callable[[Column, str], Column]:
    """How a field of an element is read: `text_at`, or `shown_at` of elements read as texts."""
    element = documents.schema["items"].dataType.elementType
    return jsontext.shown_at if isinstance(element, StructType) else jsontext.text_at


def _numbered_items(items: Column, at: Callable[[Column, str], Column]) -> Column:
    """Elements with their number among the active or among the rejected ones."""

    def numbered(group: Column, rejected: bool) -> Column:
        return F.transform(
            group,
            lambda x, i: F.struct(F.lit(rejected).alias("rejected"), (i + 1).alias("number"), x.alias("item")),
        )

    def rejected(item: Column) -> Column:
        return labels.verification_status(at(item, "verification_status")) == "rejected"

    active = F.filter(items, lambda x: ~rejected(x))
    return F.concat(numbered(active, False), numbered(F.filter(items, rejected), True))


def report_rows(documents: DataFrame) -> DataFrame:
    """Documents exploded into numbered findings; documents without findings keep one row."""
    kept = [c for c in documents.columns if c != "items"]
    rows = documents.select(*kept, F.explode_outer(_numbered_items(F.col("items"), _reader(documents))).alias("z"))
    return rows.select(*kept, "z.rejected", "z.number", "z.item")


def _location(item: Column, at: Callable[[Column, str], Column] = jsontext.text_at) -> Column:
    return labels.format_location(
        at(item, "location.file"), at(item, "location.line")
    )


def _trigger(item: Column, at: Callable[[Column, str], Column] = jsontext.text_at) -> Column:
    return labels.format_trigger(
        at(item, "trigger.method"), at(item, "trigger.path")
    )


def _severity(item: Column, at: Callable[[Column, str], Column] = jsontext.text_at) -> Column:
    return labels.effective_severity(
        at(item, "severity"), at(item, "reviewed_severity")
    )


def report_findings(documents: DataFrame) -> DataFrame:
    """Every finding of the report, active and rejected numbered separately per stage."""
    item, stage, at = F.col("item"), F.col("stage"), _reader(documents)
    stage_names = {key: label for key, label, _ in dims.REPORT_STAGES}
    label = F.create_map(*[F.lit(x) for pair in stage_names.items() for x in pair])

    def shown(key: str) -> Column:
        return at(item, key)

    return report_rows(documents).filter(F.col("number").isNotNull()).select(
        "stage_id",
        "task_id",
        "stage",
        "rejected",
        F.concat(stage, F.lit("-"), F.col("number")).alias("anchor"),
        _severity(item, at).alias("severity"),
        labels.verification_status(shown("verification_status")).alias("verification"),
        text.trim_all(shown("verification_reason")).alias("review_reason"),
        text.trim_all(shown("origin")).alias("origin"),
        text.or_default(shown("subtype"), F.try_element_at(label, stage)).alias("subtype"),
        text.or_default(shown("description"), dims.NO_DESCRIPTION).alias("description"),
        _location(item, at).alias("location"),
        _trigger(item, at).alias("trigger"),
        shown("trigger.parameter").alias("trigger_parameter"),
    )


def report_fields(documents: DataFrame) -> DataFrame:
    """Detail fields per finding: component, configured fields in order, then the others by key.

    `section` (0, 1, 2) and `ordinal` give the order; blank values are dropped.
    """
    if documents.schema["items"].dataType == VARIANTS_TYPE:
        documents = documents.withColumn("items", DETAILS.finish(DETAILS.of_items(F.col("items"))))
    rows = report_rows(documents).filter(F.col("number").isNotNull())
    ids = ["stage_id", "task_id", "stage", "rejected", "number"]
    component = labels.component_label(
        jsontext.shown_at(F.col("item"), "component_name"), jsontext.shown_at(F.col("item"), "component_version")
    )
    named = F.when(F.col("stage") == "config", component).otherwise("")
    # The component goes along as a field without key, so documents are read once.
    head = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("component").alias("said"), F.lit(None).cast("variant").alias("value")))
    entries = rows.select(*ids, "item", text.trim_all(named).alias("component")).select(
        *ids, "component", F.explode(F.concat(head, F.col("item.fields"))).alias("field")
    )
    key, value = F.col("field.key"), F.col("field.value")
    is_head = F.col("key").isNull()
    in_component = (F.col("component") != "") & F.coalesce(F.col("key").isin("component_name", "component_version"), F.lit(False))
    # Most values are plain texts; the others are formatted from their variant.
    shown = F.when(value.isNotNull(), labels.format_value(value)).otherwise(F.col("field.said"))
    values = (
        entries.select(*ids, "component", key.alias("key"), text.trim_all(shown).alias("shown"))
        .filter(~in_component)
        .filter(F.col("shown") != "")
    )
    config = F.broadcast(dims.report_field_dimension(documents.sparkSession))
    configured = F.col("ordinal").isNotNull()
    return values.join(config, ["stage", "key"], "left").select(
        *ids,
        F.when(is_head, 0).when(configured, 1).otherwise(2).alias("section"),
        F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        F.coalesce("key", F.lit("component")).alias("key"),
        F.when(is_head, dims.COMPONENT_LABEL).otherwise(F.coalesce("label", labels.pretty_label("key"))).alias("label"),
        F.col("shown").alias("value"),
        F.when(is_head, False).otherwise(F.coalesce("code", labels.is_code_field("key", "shown"))).alias("code"),
    )


def _facts(documents: DataFrame) -> DataFrame:
    """Numbered rows with what the summaries need; a row per document at least."""
    item, at = F.col("item"), _reader(documents)
    counted = F.col("number").isNotNull() & ~F.col("rejected")
    return report_rows(documents).select(
        "stage_id",
        "task_id",
        "stage",
        "state",
        "raw_text",
        "updated_at",
        F.coalesce(counted, F.lit(False)).alias("active"),
        F.coalesce(F.col("rejected"), F.lit(False)).alias("rejected"),
        _severity(item, at).alias("severity"),
        F.when(counted, F.nullif(_location(item, at), F.lit(""))).alias("location"),
        F.when(counted, F.nullif(_trigger(item, at), F.lit(""))).alias("trigger"),
    )


def report_stages(documents: DataFrame) -> DataFrame:
    """One row per reported stage, with counts, distinct locations and triggers, and a summary text."""
    names = dims.report_stage_dimension(documents.sparkSession)
    counts = (
        _facts(documents)
        .groupBy("stage_id", "task_id", "stage", "state")
        .agg(
            F.count_if("active").alias("finding_count"),
            F.count_if("rejected").alias("rejected_count"),
            # Sets of one document, which distinct counts would copy and shuffle for.
            F.size(F.collect_set("location")).cast("long").alias("unique_files"),
            F.size(F.collect_set("trigger")).cast("long").alias("unique_interfaces"),
            *severity_counts(F.col("severity"), F.col("active")),
            F.max("raw_text").alias("raw_text"),
            F.max("updated_at").alias("updated_at"),
        )
    )
    raw, none = F.col("state") == "raw", F.col("finding_count") == 0
    too_large = F.col("state") == "too_large"
    summary = (
        F.when(raw, dims.SUMMARY_RAW)
        .when(too_large, dims.SUMMARY_TOO_LARGE)
        .when(none & (F.col("rejected_count") > 0), dims.SUMMARY_ALL_REJECTED)
        .when(none, dims.SUMMARY_CLEAN)
        .otherwise(F.format_string(dims.SUMMARY_FINDINGS, "finding_count"))
    )
    return (
        counts.join(F.broadcast(names.select("stage", "ordinal", "label")), "stage")
        .withColumn("raw_only", raw)
        .withColumn("zero_findings", ~raw & ~too_large & none)
        .withColumn("summary", summary)
        .withColumn("completed_at", labels.format_ts("updated_at"))
        .drop("state", "updated_at")
    )


def report_overview(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per task with at least one reported stage.

    Locations and triggers are distinct over the whole task, not summed; the
    interface count is never below the route count.
    """
    structured = F.col("state") == "array"
    # Documents by kind are counted as distinct ids, so one aggregate over one parse gives them all.
    counts = (
        _facts(documents)
        .groupBy("task_id")
        .agg(
            F.count_distinct("stage_id").alias("completed_stage_count"),
            F.count_distinct(F.when(structured, F.col("stage_id"))).alias("_structured"),
            F.count_distinct(F.when(structured & F.col("active"), F.col("stage_id"))).alias("_with_findings"),
            F.count_if("active").alias("total_findings"),
            F.count_distinct("location").alias("unique_files"),
            F.count_distinct("trigger").alias("unique_interfaces"),
            *severity_counts(F.col("severity"), F.col("active")),
        )
        .withColumn("clean_stage_count", F.col("_structured") - F.col("_with_findings"))
        .drop("_structured", "_with_findings")
    )
    return counts.join(route_counts(tasks), "task_id").withColumn(
        "unique_interfaces", F.greatest("unique_interfaces", "route_count")
    )


def report_errors(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """Tasks that have nothing to report."""
    return tasks.select("task_id").join(documents.select("task_id").distinct(), "task_id", "left_anti")


def report_task_header(tasks: DataFrame) -> DataFrame:
    """Task part of the report: short id, name with a default, trimmed remark, creation time."""
    return tasks.select(
        "task_id",
        labels.short_id("task_id").alias("short_id"),
        text.or_default("name", dims.UNNAMED_TASK).alias("name"),
        text.trim_all("remark").alias("remark"),
        labels.format_ts("created_at").alias("created_at"),
    )


def report_tables(tasks: DataFrame, stages: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report: header, overview, stages, findings and detail fields.

    The parsed documents are written once, as four of the tables are made from them.
    """
    documents = written_table(report_documents(stages, FULL), "report-documents")
    return {
        "tasks": report_task_header(tasks),
        "overview": report_overview(tasks, documents),
        "stages": report_stages(documents),
        "findings": report_findings(documents),
        "fields": report_fields(documents),
    }


def ui_report_overview(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """The user interface's overview: nine stages, distinct files without line, raw stages counted.

    On repeated names the first document counts.
    """
    known = stages.filter(F.col("name").isin(KNOWN_STAGES))
    first = known.groupBy("task_id", "name").agg(F.min(F.struct("created_at", "stage_id")).alias("first"))
    chosen = known.join(first.select(F.col("first.stage_id").alias("stage_id")), "stage_id", "left_semi")
    seen = where_parsed(
        ui_items(chosen.filter(F.col("status") == "completed"), UI_TEXTS), F.col("items").isNotNull() | F.col("has_payload")
    )

    def rejected(x: Column) -> Column:
        return labels.verification_status(jsontext.shown_at(x, "verification_status")) == "rejected"

    rows = seen.select(
        "task_id",
        "stage_id",
        F.col("items").isNull().alias("raw_only"),
        F.explode_outer(F.filter("items", lambda x: ~rejected(x))).alias("item"),
    )
    item = F.col("item")
    active = item.isNotNull()
    signature = labels.trigger_signature_ui(
        jsontext.shown_at(item, "trigger.method"), jsontext.shown_at(item, "trigger.path")
    )
    facts = rows.select(
        "task_id",
        "stage_id",
        "raw_only",
        active.alias("active"),
        _severity(item, jsontext.shown_at).alias("severity"),
        F.nullif(jsontext.shown_at(item, "location.file"), F.lit("")).alias("file"),
        F.when(active, F.nullif(signature, F.lit(""))).alias("trigger"),
    )
    structured = ~F.col("raw_only")
    counts = (
        facts.groupBy("task_id")
        .agg(
            F.count_distinct("stage_id").alias("stage_count"),
            F.count_if("active").alias("total_findings"),
            F.count_distinct(F.when(structured, F.col("stage_id"))).alias("_structured"),
            F.count_distinct(F.when(structured & F.col("active"), F.col("stage_id"))).alias("_with_findings"),
            F.count_distinct(F.when(F.col("raw_only"), F.col("stage_id"))).alias("raw_only_stage_count"),
            F.count_distinct("file").alias("unique_files"),
            F.count_distinct("trigger").alias("unique_interfaces"),
            *severity_counts(F.col("severity"), F.col("active")),
        )
        .withColumn("clean_stage_count", F.col("_structured") - F.col("_with_findings"))
        .drop("_structured", "_with_findings")
    )
    return counts.join(route_counts_ui(tasks), "task_id").withColumn(
        "unique_interfaces", F.greatest("unique_interfaces", "route_count")
    )
