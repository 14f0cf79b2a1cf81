"""Connected components of an edge list, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that an edge touches; the root is the component's smallest node.

    Each round a node takes the smallest label around it and then the label of that
    label, so labels cross long chains in few rounds.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    ways = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        around = ways.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("further"))
        now = cut(least.join(jump, "new").select("node", F.least("new", "further").alias("next"), "root"))
        if now.where("next <> root").isEmpty():
            return labels
        labels = now.select("node", F.col("next").alias("root"))
