"""Readers of corpora, tasks, stages, transcripts and states; writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims, schemas
from siftlake.functions import paths
from siftlake.functions.text import byte_length


# ---- corpora ----


def read_corpus(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Project trees `<root>/<task_id>/<path>` as (task_id, path, bytes, content).

    Unreadable files are skipped. Extensions are pruned at listing time by the
    glob; the content is decoded only when it is selected.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(root)
    )
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    rel = F.substring(F.col("path"), F.instr("path", marker) + len(marker), F.length("path"))
    return raw.select(
        F.split_part(rel, F.lit("/"), F.lit(1)).alias("task_id"),
        F.substring(rel, F.instr(rel, "/") + 1, F.length(rel)).alias("path"),
        F.col("length").alias("bytes"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def corpus_table(files: DataFrame) -> DataFrame:
    """A table of (task_id, path, content) in the form `read_corpus` returns."""
    return files.select(
        "task_id",
        paths.clean_path("path").alias("path"),
        byte_length("content").cast("long").alias("bytes"),
        "content",
    )


def corpus_quota(files: DataFrame, max_bytes: int = dims.MAX_PROJECT_BYTES) -> DataFrame:
    """Admission verdict per project: total size and entries that would leave the project."""
    clean = paths.clean_path("path")
    escapes = clean.startswith("/") | (clean == "..") | clean.startswith("../")
    totals = files.groupBy("task_id").agg(
        F.count("*").alias("file_count"),
        F.sum(byte_length("content")).alias("bytes"),
        F.count_if(escapes).alias("escaping"),
    )
    reason = F.when(F.col("escaping") > 0, "escapes_project").when(F.col("bytes") > max_bytes, "too_large")
    return totals.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn(
        "admitted", F.col("reason") == "ok"
    )


# ---- tasks and stages ----


def outer_join_by_parts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer join whose right side may have hot keys.

    A left outer join cannot split a skewed right side, an inner join can; the
    unmatched left rows come from an anti join against the distinct keys.
    """
    matched = left.join(right, keys)
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def tasks_with_stages(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Every task with each of its stages; tasks without stages kept once."""
    rows = stages.select(
        "task_id",
        "stage_id",
        F.col("name").alias("stage"),
        F.col("status").alias("stage_status"),
        F.col("created_at").alias("stage_created_at"),
    )
    return outer_join_by_parts(tasks.select("task_id", "name", "status", "created_at"), rows, ["task_id"])


def read_tasks(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """The task list's scan: pruned columns with stages attached, newest task first."""
    return tasks_with_stages(tasks, stages).orderBy(
        F.desc("created_at"), "task_id", "stage_created_at", "stage_id"
    )


def read_task_detail(tasks: DataFrame, stages: DataFrame, task_id: Column) -> DataFrame:
    """One task (pushed to both scans), stages oldest first."""
    return tasks_with_stages(
        tasks.filter(F.col("task_id") == task_id), stages.filter(F.col("task_id") == task_id)
    ).orderBy("stage_created_at", "stage_id")


def completion(stages: DataFrame) -> DataFrame:
    """Status of a task after a run: completed once no stage is running, else null."""
    return stages.groupBy("task_id").agg(
        F.when(F.count_if(F.col("status") == "running") == 0, "completed").alias("new_status")
    )


def delete_tasks(tasks: DataFrame, stages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch deletion: (remaining tasks, remaining stages, outcome per requested id).

    Outcomes are deleted, not_found and conflict (the task is running).
    """
    wanted = ids.select("task_id").distinct()
    known = tasks.select("task_id", "status")
    outcome = wanted.join(known, "task_id", "left").select(
        "task_id",
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") == "running", "conflict")
        .otherwise("deleted")
        .alias("outcome"),
    )
    gone = outcome.filter(F.col("outcome") == "deleted").select("task_id")
    return (
        tasks.join(gone, "task_id", "left_anti"),
        stages.join(gone, "task_id", "left_anti"),
        outcome,
    )


# ---- transcripts and states ----


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines message log; blank lines are skipped, a malformed line is an error, a missing log is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    if not found:
        return spark.createDataFrame([], schemas.MESSAGES)
    return spark.read.schema(schemas.MESSAGES).option("mode", "FAILFAST").json(path)


def read_states(spark: SparkSession, root: str, glob: str = "state.json", lines: bool = False) -> DataFrame:
    """All `<root>/<task_id>/<stage>/state.json`; invalid ones are skipped.

    With `lines` a file of a stage's folder holds many states, one on each line: a folder for each session means a file
    to make, move, list and open for every one of them. `session` is the state's own or `task_id/stage`, the key of its messages and artifacts.
    """
    raw = (
        spark.read.schema(f"{schemas.STATES}, _corrupt_record string")
        .option("multiLine", not lines)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(root)
    )
    folder = F.split(F.col("_metadata.file_path"), "/")
    # Folders may carry their column's name, as partitioned writers make them.
    name = F.regexp_replace(F.element_at(folder, -2), "^stage=", "")
    return (
        raw.withColumn("folder", name)
        .filter(F.col("_corrupt_record").isNull() & F.col("status").isNotNull())
        .withColumn("stage", F.col("folder"))
        .withColumn("session", F.coalesce("session", F.concat_ws("/", "task_id", "stage")))
        .drop("_corrupt_record", "folder")
    )


def append_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Number new messages `msg-%06d` after the stored ones and chain their parents.

    `incoming` has (session, seq, ...) with `seq` increasing inside a session.
    """
    from siftlake.operators.running import running

    last = stored.groupBy("session").agg(
        F.max(F.regexp_extract("id", r"^msg-(\d+)$", 1).try_cast("long")).alias("last_no"),
        F.max_by("id", "seq").alias("last_id"),
        F.max("seq").alias("last_seq"),
    )
    numbered = running(incoming, ["session"], "seq", sums={"n": F.lit(1)})
    number = F.coalesce(F.col("last_no"), F.lit(0)) + F.col("n")
    name = F.format_string("msg-%06d", number)
    parent = F.when(F.col("n") == 1, F.col("last_id")).otherwise(F.format_string("msg-%06d", number - 1))
    return numbered.join(last, "session", "left").select(
        *[c for c in incoming.columns if c not in ("id", "parent_id", "seq")],
        name.alias("id"),
        parent.alias("parent_id"),
        (F.coalesce(F.col("last_seq"), F.lit(0)) + F.col("n")).alias("seq"),
    )


# ---- results ----


def stage_documents(findings: DataFrame, keys: list[str], part_rows: int | None = None) -> DataFrame:
    """Findings (keys, pos, item) as one JSON array for each group of keys: (keys, part, n, output_json).

    A stage's result is one document, as every reader takes it. A writer that must bound its documents
    may ask for parts of `part_rows` findings by position; `whole_documents` puts parts together again.
    """
    part = F.lit(0).cast("long") if part_rows is None else F.floor(F.col("pos") / part_rows)
    rows = findings.select(*keys, part.alias("part"), "pos", F.col("item"))
    return (
        rows.groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("items"))
        .select(
            *keys,
            "part",
            F.size("items").alias("n"),
            F.concat(F.lit("["), F.array_join(F.transform("items", lambda r: r["item"]), ","), F.lit("]")).alias(
                "output_json"
            ),
        )
    )


def whole_documents(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of documents joined in order: (keys, n, output_json)."""
    inner = F.substring(F.col("output_json"), F.lit(2), F.length("output_json") - 2)
    filled = parts.filter(F.col("n") > 0).select(*keys, "part", "n", inner.alias("body"))
    whole = filled.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "body"))).alias("bodies")
    )
    joined = F.array_join(F.transform("bodies", lambda b: b["body"]), ",")
    return whole.select(*keys, "n", F.concat(F.lit("["), joined, F.lit("]")).alias("output_json"))


def write_report_tables(report: dict[str, DataFrame], path: str) -> None:
    """The report tables as one parquet folder each."""
    for name, table in report.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


