"""Running values over long ordered groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import written_table


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add running sums, last non-null values (both up to and including the row) and group totals.

    `seq` is unique inside a group. Rows are dealt out by ranges of (keys, seq), which Spark
    cuts by numbers of rows whatever the values, so a group with a third of all rows is spread over a
    third of the tasks. Only the keys, `seq` and the values go there, as a written table; one small row per
    group and range carries the values over. `df` is evaluated twice: for the values and for the result.
    """
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    values = {**sums, **lasts, **totals}
    slim = df.select(*keys, seq, *[v.alias(f"_{n}") for n, v in values.items()])
    by = [*keys, seq]
    dealt = slim.repartitionByRange(parts, *by) if parts else slim.repartitionByRange(*by)
    # The part is stored with the row: a second evaluation might cut the ranges elsewhere.
    rows = written_table(dealt.withColumn("_part", F.spark_partition_id()), "running")
    per_part = rows.groupBy(*keys, "_part").agg(
        *[F.sum(f"_{n}").alias(f"_{n}_part") for n in (*sums, *totals)],
        *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(seq))).alias(f"_{n}_part") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = per_part.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_{n}_part").over(before), F.lit(0)).alias(f"_{n}_carry") for n in sums],
        *[F.last(f"_{n}_part", ignorenulls=True).over(before).alias(f"_{n}_carry") for n in lasts],
        *[F.sum(f"_{n}_part").over(whole).alias(n) for n in totals],
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.join(carried, [*keys, "_part"]).select(
        *by,
        *[(F.col(f"_{n}_carry") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"_{n}_carry")).alias(n) for n in lasts],
        *[F.col(n) for n in totals],
    )
    return out if df.columns == by else df.join(out, by).select(*df.columns, *values)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Add each row's place (from 1) in the order of its group, as a long.

    Rows are written by ranges of (keys, order), counted by group and range, and numbered inside their range after the
    rows of the ranges before it: `df` is evaluated once and a group with a third of all rows is spread over a third of
    the tasks. Equal rows get places in any order; keys are not null.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = written_table(dealt, "positions")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    carried = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        rows.withColumn("_at", place)
        .join(carried, [*keys, "_part"])
        .select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))
    )
