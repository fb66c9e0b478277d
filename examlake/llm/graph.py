"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b); ``comp`` is the component's smallest node.

    Each round gives a node the smallest label next to it and then that label's own label, so a path's length halves
    or better. Labels are written between rounds; nothing but a count comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        moved = lower.join(jump, "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved"))
        after = stored(moved, name)
        labels = after.select("node", "comp")
        if not after.where("moved").limit(1).count():
            return labels
