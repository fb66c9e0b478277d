"""Roll-ups of answers, sheets and papers: one conditional aggregation per child table, then left joins.

All keep "none" (0 of none) apart from "unknown" (null), and order ties explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import with_upper_median


def final_answers(answers: DataFrame) -> DataFrame:
    """What counts is the teacher's verdict and score where there is one, else the system's."""
    return answers.withColumn("verdict", F.coalesce("teacher_verdict", "verdict")).withColumn("score_got", F.coalesce("teacher_score_got", "score_got")).drop("teacher_verdict", "teacher_score_got")


def list_sheets(sheets: DataFrame, final: DataFrame) -> DataFrame:
    """A2: per sheet the answers, wrong and partial ones, and points lost; a right answer loses nothing."""
    known = F.col("score_got").isNotNull() & F.col("score_full").isNotNull() & F.col("verdict").isin("right", "wrong", "partial", "blank")
    lost = F.when(known, F.when(F.col("verdict") == "right", F.lit(0)).otherwise(F.col("score_full") - F.col("score_got")))
    per = final.groupBy("sheet_id").agg(F.count("*").alias("n_answers"), F.count_if(F.col("verdict") == "wrong").alias("n_wrong"), F.count_if(F.col("verdict") == "partial").alias("n_partial"), F.sum(lost.cast("decimal(18,4)")).alias("lost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sheets.join(per, "sheet_id", "left").select("sheet_id", "paper_id", zero("n_answers"), zero("n_wrong"), zero("n_partial"), F.coalesce("lost", F.lit(0)).cast("double").alias("lost"))


def weak_spots(answers: DataFrame, topic: str, by: Sequence[str], top: int = 3) -> DataFrame:
    """The topics that lose most, of answers with both scores and a gap; ties by topic."""
    gap = (F.col("score_full") - F.col("score_got")).cast("decimal(18,4)")
    per = answers.withColumn("gap", gap).where("gap > 0").groupBy(*by, topic).agg(F.sum("gap").alias("lost"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("lost"), topic))
    return per.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, topic, F.col("lost").cast("double").alias("lost"), "n", "rank")


def progress(parents: DataFrame, children: DataFrame, key: str, counts: dict[str, Column], changed: str, as_of: Column) -> DataFrame:
    """A1: all counts of a parent's children in one pass, the last change of either, and how long that is ago."""
    per = children.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.max(changed).alias("_last"))
    last = F.greatest("_last", "created_at")
    idle = F.unix_timestamp(as_of) - F.unix_timestamp(last)
    return parents.join(per, key, "left").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], last.alias("last_change"), idle.alias("idle_seconds"), (idle < 180).alias("busy"))


def full_score(answers: DataFrame, key: str) -> DataFrame:
    """Sum of full scores, only if none is missing and the sum is positive."""
    total = F.when((F.count_if(F.col("score_full").isNull()) == 0) & (F.sum("score_full") > 0), F.sum("score_full"))
    return answers.groupBy(key).agg(total.cast("double").alias("full_score"))


def boilerplate(boxes: DataFrame, page: str, box: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Boxes that stand on more than half of the distinct pages."""
    pages = boxes.groupBy(*within).agg(F.count_distinct(page).alias("n_pages"))
    per = boxes.groupBy(*within, *box).agg(F.count_distinct(page).alias("n_on"))
    return per.join(pages, list(within)).where(F.col("n_on") * 2 > F.col("n_pages"))


def constant_keys(samples: DataFrame, case: str, key: str, value: str) -> DataFrame:
    """Keys whose value never changes within any case."""
    per = samples.groupBy(case, key).agg((F.max(value) == F.min(value)).alias("flat"))
    return per.groupBy(key).agg(F.bool_and("flat").alias("constant"), F.count("*").alias("n_cases"))


def run_report(log: DataFrame, key: str, order: str, verdict: str) -> DataFrame:
    """Rounds, first and final verdict of each key of a verification log."""
    by = F.struct(order, verdict)
    return log.groupBy(key).agg(F.count("*").alias("rounds"), F.min(by)[verdict].alias("first_verdict"), F.max(by)[verdict].alias("final_verdict"))
