"""Readers for the driver tables, and the roles that they play for the operators.

papers = customers, sheets (one student's attempt) = orders, answers = lineitems, topics = part brands.
Scores are decimals; nothing here has a clock, so operators that need a time take ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner_id"), F.col("c_mktsegment").alias("kind"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderdate").alias("created_at"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem; ``n`` numbers a sheet's lines in the order of all columns, as line numbers repeat."""
    full = F.col("l_extendedprice").cast("decimal(18,2)")
    less = lambda c: (full * (1 - F.col(c).cast("decimal(4,2)"))).cast("decimal(18,4)")
    verdict = F.when(F.col("l_returnflag") == "R", "right").when(F.col("l_returnflag") == "A", "wrong").otherwise("partial")
    open_ = F.col("l_linestatus") == "O"
    # columns get their names after the numbering: rows dealt by l_orderkey are then known to lie by sheet_id
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))).select(
        F.col("l_orderkey").alias("sheet_id"),
        "n",
        F.col("l_partkey").alias("part_id"),
        verdict.alias("verdict"),
        F.when(open_ & (F.col("l_tax") < 0.02), "right").alias("teacher_verdict"),
        full.alias("score_full"),
        less("l_discount").alias("score_got"),
        F.when(open_, less("l_tax")).alias("teacher_score_got"),
        F.col("l_shipdate").alias("updated_at"),
    )


#: the same roles as common table expressions
PAPERS_SQL = "papers AS (SELECT c_custkey AS paper_id, c_name AS name, c_nationkey AS owner_id, c_mktsegment AS kind FROM customer)"
SHEETS_SQL = "sheets AS (SELECT o_orderkey AS sheet_id, o_custkey AS paper_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderdate AS created_at FROM orders)"
ANSWERS_SQL = f"""answers AS (SELECT l_orderkey AS sheet_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) AS n, l_partkey AS part_id,
 CASE l_returnflag WHEN 'R' THEN 'right' WHEN 'A' THEN 'wrong' ELSE 'partial' END AS verdict,
 CASE WHEN l_linestatus = 'O' AND l_tax < 0.02 THEN 'right' END AS teacher_verdict,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS score_full,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS score_got,
 CASE WHEN l_linestatus = 'O' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) END AS teacher_score_got,
 l_shipdate AS updated_at FROM lineitem)"""
FINAL_SQL = ANSWERS_SQL + ", final AS (SELECT sheet_id, n, part_id, coalesce(teacher_verdict, verdict) AS verdict, coalesce(teacher_score_got, score_got) AS score_got, score_full, updated_at FROM answers)"
