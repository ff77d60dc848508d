"""Dashboard statistics, task list, coverage, stage cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import jsontext, labels
from siftlake.operators.findings import (
    KNOWN_STAGES,
    completed_known_stages,
    explode_findings,
    parse_findings,
    route_counts,
    ui_items,
)


# What the roll-ups read of an element.
TEXTS = jsontext.texts(["severity", "reviewed_severity", "verification_status"])


def _item_severity(item: Column) -> Column:
    return labels.effective_severity(
        jsontext.shown_at(item, "severity"), jsontext.shown_at(item, "reviewed_severity")
    )


def stage_rows(stages: DataFrame) -> DataFrame:
    """Completed known stages exploded once for all roll-ups: (stage_id, task_id, stage, state, pos,
    is_first, is_active, severity).

    Every stage keeps at least one row, so counts at stage and finding grain
    come from the same pass: `is_first` marks one row per stage.
    """
    docs = completed_known_stages(stages).select(
        "stage_id", "task_id", F.col("name").alias("stage"), "result", "output_json"
    )
    parsed = parse_findings(docs, TEXTS).select("stage_id", "task_id", "stage", "state", "items")
    rows = explode_findings(parsed, keep_empty=True)
    status = labels.verification_status(jsontext.shown_at(F.col("item"), "verification_status"))
    active = F.col("pos").isNotNull() & (status != "rejected")
    return rows.select(
        "stage_id",
        "task_id",
        "stage",
        "state",
        "pos",
        (F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("is_first"),
        F.coalesce(active, F.lit(False)).alias("is_active"),
        _item_severity(F.col("item")).alias("severity"),
    )


def dashboard_stats(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """One row: projects, interfaces, completed audits, active findings.

    Each grain is aggregated by itself and the partial rows are added up.
    """
    zero = F.lit(0).cast("long")
    by_task = route_counts(tasks).agg(
        F.count("*").alias("projects"), F.coalesce(F.sum("route_count"), zero).alias("interfaces")
    )
    by_stage = stage_rows(stages).agg(
        F.count_if("is_first").alias("completed_audits"), F.count_if("is_active").alias("vulns")
    )
    names = ["projects", "interfaces", "completed_audits", "vulns"]
    return by_task.unionByName(by_stage, allowMissingColumns=True).agg(*[F.sum(n).alias(n) for n in names])


def status_breakdown(tasks: DataFrame) -> DataFrame:
    """The five task statuses with their counts, zeros kept."""
    counts = tasks.groupBy(labels.norm_task_status("status").alias("status")).agg(F.count("*").alias("n"))
    table = tasks.sparkSession.createDataFrame([(s,) for s in dims.TASK_STATUSES], "status string")
    return table.join(F.broadcast(counts), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n")
    )


def severity_breakdown(rows: DataFrame) -> DataFrame:
    """Active findings by severity, highest first, absent severities dropped."""
    counts = rows.filter("is_active").groupBy("severity").agg(F.count("*").alias("n"))
    return counts.select(
        "severity", "n", labels.severity_rank("severity").alias("rank"), F.lower("severity").alias("tone")
    ).orderBy(F.desc("rank"))


def stage_coverage(stages: DataFrame) -> DataFrame:
    """Completed stage documents per known stage, zeros kept, in dimension order."""
    counts = completed_known_stages(stages).groupBy(F.col("name").alias("stage")).agg(F.count("*").alias("n"))
    return (
        dims.stage_dimension(stages.sparkSession)
        .join(counts, "stage", "left")
        .select("ordinal", "stage", "label", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("ordinal")
    )


def task_list(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per task with counts and the highest severity, newest first.

    Without findings the severity is UNKNOWN when a completed stage is raw
    only, else NONE.
    """
    per_task = stage_rows(stages).groupBy("task_id").agg(
        F.count_if("is_first").alias("completed_stage_count"),
        F.count_if("is_active").alias("finding_count"),
        F.max(F.when(F.col("is_active"), labels.severity_rank("severity"))).alias("top_rank"),
        F.bool_or(F.col("state") == "raw").alias("raw_only"),
    )
    names = F.create_map(*[F.lit(x) for n, r in dims.SEVERITY_RANK.items() for x in (r, n)])
    zero = F.lit(0).cast("long")
    own = tasks.select("task_id", "name", "remark", "status", "created_at", "result", "output_json")
    routes = parse_findings(own).withColumn(
        "route_count", F.when(F.col("items").isNotNull(), F.size("items")).otherwise(0)
    )
    return (
        routes.select("task_id", "name", "remark", "status", "created_at", "route_count")
        .join(per_task, "task_id", "left")
        .select(
            "task_id",
            "name",
            "remark",
            "status",
            "created_at",
            "route_count",
            F.coalesce("finding_count", zero).alias("finding_count"),
            F.coalesce("completed_stage_count", zero).alias("completed_stage_count"),
            F.lit(len(dims.STAGES)).alias("total_stage_count"),
            F.when(F.col("top_rank").isNotNull(), F.try_element_at(names, F.col("top_rank")))
            .when(F.col("raw_only"), "UNKNOWN")
            .otherwise("NONE")
            .alias("highest_severity"),
        )
        .orderBy(F.desc("created_at"), "task_id")
    )


def latest_ids(stages: DataFrame) -> DataFrame:
    """(stage_id) of the later document per (task, stage name)."""
    last = stages.groupBy("task_id", "name").agg(F.max(F.struct("created_at", "stage_id")).alias("last"))
    return last.select(F.col("last.stage_id").alias("stage_id"))


def latest_stage_by_name(stages: DataFrame) -> DataFrame:
    """The later document per (task, stage name): only ids are aggregated, documents are joined back."""
    return stages.join(latest_ids(stages), "stage_id", "left_semi")


def stage_cards(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """All nine stages of every task: status, number of items (rejected included), detail code.

    On repeated names the first document counts. The nine stages are exploded
    from a literal. Documents are counted where they are read, so only narrow rows are shuffled,
    once for the choice and the join.
    """
    facts = ui_items(stages.filter(F.col("name").isin(KNOWN_STAGES)), jsontext.SIZES).select(
        "task_id",
        F.col("name").alias("stage"),
        "created_at",
        "stage_id",
        "status",
        F.when(F.col("items").isNotNull(), F.size("items")).alias("finding_count"),
        "has_payload",
    )
    own = Window.partitionBy("task_id", "stage")
    first = F.min(F.struct("created_at", "stage_id")).over(own)
    facts = facts.withColumn("_first", first).filter(F.col("stage_id") == F.col("_first.stage_id"))
    facts = facts.drop("_first", "created_at", "stage_id")
    names = F.array(*[F.lit(k) for k in KNOWN_STAGES])
    slots = tasks.select("task_id", F.posexplode(names).alias("ordinal", "stage"))
    n, done = F.col("finding_count"), F.col("status") == "completed"
    detail = (
        F.when(F.col("status") == "running", "running")
        .when(F.col("status") == "failed", "failed")
        .when(done & (n == 0), "clean")
        .when(done & n.isNotNull(), "findings")
        .when(done & F.col("has_payload"), "raw")
        .otherwise("waiting")
    )
    return slots.join(facts, ["task_id", "stage"], "left").select(
        "task_id",
        "ordinal",
        "stage",
        F.coalesce("status", F.lit("pending")).alias("status"),
        "finding_count",
        detail.alias("detail"),
    )


def status_percent(tasks: DataFrame) -> DataFrame:
    """Share of every status in percent, rounded half up; the window spans five rows."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.floor(F.col("n") * 100 / total + 0.5)
    return status_breakdown(tasks).withColumn("percent", F.when(total == 0, 0).otherwise(share))


def severity_scale(rows: DataFrame) -> DataFrame:
    """Bar width per severity: at least 12, at most 100; the window spans five rows."""
    top = F.max("n").over(Window.partitionBy(F.lit(1)))
    return severity_breakdown(rows).withColumn(
        "width", F.greatest(F.lit(12), F.floor(F.col("n") * 100 / top + 0.5))
    )


def dominant_severity(rows: DataFrame) -> DataFrame:
    """The highest severity present, which need not be the most frequent."""
    return severity_breakdown(rows).agg(
        F.max_by("severity", "rank").alias("severity"), F.max_by("n", "rank").alias("n")
    )


def severity_counts(severity: Column, counted: Column) -> list[Column]:
    """One count per severity, as aggregate columns."""
    return [
        F.count_if(counted & (severity == label)).alias(label.lower()) for label in dims.SEVERITY_RANK
    ]
