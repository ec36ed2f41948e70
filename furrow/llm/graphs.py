"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import stage
from furrow.session import ship_by_value


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Each round a node takes the least label among its neighbours, then the label
    of its label. A node with very many neighbours is combined inside each task.
    Labels are written every round; the loop ends when none has changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a")
                .agg(F.min("component").alias("m")))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        following = stage(lower.join(jump, F.col("new") == F.col("at"), "left").select(
            "node", F.least("new", F.coalesce("further", "new")).alias("component"), "old"), "labels")
        labels = following.select("node", "component")
        if following.filter("component <> old").isEmpty():
            return labels


ship_by_value(__name__)
