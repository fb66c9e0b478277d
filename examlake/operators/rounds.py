"""Fixpoints over tables: rounds of joins, with the lineage cut after each in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder; a temporary one only on a single machine that names none."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="examlake-rounds-"))
    return df.checkpoint()


def components(edges: DataFrame, within: str, left: str, right: str) -> DataFrame:
    """(within, left, comp): components of a two-sided graph in each ``within``; ``comp`` is the smallest ``left`` of one.

    A round takes the smallest label across the right side and then that label's own label, so paths shrink by half or
    better; a key with very many edges costs joins on it, not a task's memory.
    """
    edges = cut(edges.select(within, left, right).distinct())
    labels = cut(edges.select(within, left).distinct().withColumn("comp", F.col(left)))
    while True:
        across = edges.join(labels, [within, left]).groupBy(within, right).agg(F.min("comp").alias("near"))
        near = edges.join(across, [within, right]).groupBy(within, left).agg(F.min("near").alias("near"))
        own = labels.select(within, F.col(left).alias("near"), F.col("comp").alias("far"))
        after = cut(labels.join(near, [within, left]).join(own, [within, "near"]).select(within, left, F.least("near", "far").alias("comp"), (F.least("near", "far") < F.col("comp")).alias("moved")))
        labels = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return labels
