"""Shared steps: table reads, written intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlake.session import configure, written_table

# An Arrow batch holds at most so many bytes and rows, so a task's memory does not follow the table.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def session(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on."""
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage ends here."""
    return written_table(df, f"llm-{name}")


def forget(df: DataFrame) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def arrow_map(
    df: DataFrame,
    schema: T.StructType | str,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    rows: int = 500,
) -> DataFrame:
    """Apply a function of column lists to Arrow batches.

    `make` runs once in each task and returns the function; it gets and returns
    lists by column name. At most `rows` rows are turned into Python objects at once.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = apply({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)
