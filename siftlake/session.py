"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results or for skewed keys.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # last key wins, as in the audited data
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Java compiles no method of over 8000 bytes, and a stage of JSON texts is one of far more: such stages run as split methods.
WIDE_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession, more: dict[str, str] | None = None) -> SparkSession:
    """Apply the runtime settings, and more if given, to an existing session."""
    for key, value in {**RUNTIME_CONF, **(more or {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Where that setting is absent, a folder inside the session's warehouse. A warehouse on the driver's own disk serves
    only sessions whose executors are there too; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_siftlake"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage ends here.

    A lost executor loses nothing of it. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
