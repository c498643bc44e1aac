"""Connected components of a graph of any size, by hooking and contracting.

In each round every node hooks to its smallest neighbour if that is smaller than itself,
chains of hooks are shortened to their ends, and links inside one tree go.  Everything
between rounds is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.sources.sinks import stage


def shortened(up: DataFrame) -> DataFrame:
    """``up`` (node, to) with ``to`` followed to the end of the chain."""
    while True:
        over = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = stage(
            up.join(over, "to", "left").select(
                "node",
                F.coalesce("next", "to").alias("to"),
                (F.col("next") != F.col("to")).alias("moved"),
            )
        )
        up = moved.select("node", "to")
        if not moved.filter("moved").head(1):
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); smallest node of each component."""
    rest = stage(links.filter("a != b").distinct())
    labels = None
    while rest.head(1):
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            rest.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        up = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))
        up = shortened(stage(up))
        if labels is None:
            labels = up.withColumnRenamed("to", "component")
        else:
            again = up.select(F.col("node").alias("component"), F.col("to").alias("better"))
            labels = stage(
                labels.join(again, "component", "left").select(
                    "node", F.coalesce("better", "component").alias("component")
                )
            )
        to = lambda end: up.select(F.col("node").alias(end), F.col("to").alias(end + "_to"))
        rest = stage(
            rest.join(to("a"), "a")
            .join(to("b"), "b")
            .filter("a_to != b_to")
            .select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
            .distinct()
        )
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
