"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of `links` (a, b) reaches.

    Each round a node takes the smallest label among its neighbours' and then the label of that
    label, so long chains halve. Labels are added up per node before their shuffle, so a node with
    many links is no hot key, and joins that meet one are split at run time. Every round is a written table.
    Nodes are not null; links of a node with itself and repeated ones count once or not; no links give no rows.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct()
    both = written(both, "links")
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("low"))
            .select(F.col("a").alias("node"), "low")
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label")
        )
        step = written(step, "labels")  # so that the join on a label of many nodes can be split
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(
            step.join(jump, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return labels
