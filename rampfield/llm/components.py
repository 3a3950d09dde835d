"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of the longest path. Labels are
    written after every round; only the number of changed labels reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "comp": "low"}), "b")
            .groupBy("a").agg(F.min("low").alias("low")).withColumnRenamed("a", "node")
        )
        least = labels.join(near, "node").select("node", F.least("comp", "low").alias("next"), "comp")
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = stored(
            least.join(jump, "next", "left")
            .select("node", F.least(F.col("next"), F.coalesce("far", "next")).alias("comp"), F.col("comp").alias("old"))
        )
        labels = new.select("node", "comp")
        if new.filter("comp <> old").limit(1).count() == 0:
            return labels
