"""Queries of record updates, sessions and further windows over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, merge, state, windows
from ..sources.tables import PAPERS_SQL, SHEETS_SQL, papers, sheets, table

AS_OF = "2024-01-20 00:00:00"


def m12_put_spec(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "part").where("p_partkey % 5 <> 0").select("p_partkey", "p_name", F.when(F.col("p_size") > 20, "approved").otherwise("rejected").alias("status"))
    new = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return merge.reset_on_change(old, new, "p_partkey", ["p_name"], "status")


M12 = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 <> 0 AND (p_partkey % 3 <> 0 OR upper(p_name) = p_name) THEN CASE WHEN p_size > 20 THEN 'approved' ELSE 'rejected' END ELSE 'draft' END AS status FROM part"


def m15_put_outline(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("label"), F.col("p_type").alias("short"))
    new = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "new").alias("label"), F.when(F.col("p_partkey") % 6 == 0, "brief").alias("short"))
    return merge.partial_update(old, new, "p_partkey", ["label", "short"])


M15 = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS label, CASE WHEN p_partkey % 6 = 0 THEN 'brief' ELSE p_type END AS short, p_partkey % 4 = 0 OR p_partkey % 6 = 0 AS touched FROM part"


def m21_claim(spark: SparkSession, d: str) -> DataFrame:
    rows = papers(spark, d).select("paper_id", F.when(F.col("owner_id") > 5, F.col("owner_id")).alias("owner_id"))
    return merge.claim_orphans(rows, "owner_id", F.lit(99)).groupBy("owner_id").agg(F.count("*").alias("n"))


M21 = f"WITH {PAPERS_SQL} SELECT CASE WHEN owner_id > 5 THEN owner_id ELSE 99 END AS owner_id, count(*) AS n FROM papers GROUP BY 1"


def st4_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"))
    return state.sessions(rows, F.lit(AS_OF).cast("timestamp"), "expires_at", "user_id")


ST4 = f"SELECT user_id, count(*) AS n_live, max(ts + INTERVAL 2 DAY) AS until FROM events WHERE ts + INTERVAL 2 DAY > TIMESTAMP '{AS_OF}' GROUP BY 1"


def st6_sweep(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type"))
    swept = state.sweep(status, F.col("ts"), F.lit(AS_OF).cast("timestamp"), 86400)
    return table(spark, d, "events").groupBy(swept.alias("status")).agg(F.count("*").alias("n"))


ST6 = f"SELECT CASE WHEN event_type = 'view' THEN CASE WHEN epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)) >= 86400 THEN 'error' ELSE 'running' END ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1"


def st7_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(state.log_line(F.col("text"))).alias("line_md5"))


ST7 = r"SELECT doc_id, md5(left(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), 400)) AS line_md5 FROM documents"


def k6_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") > 25, "[[fig1]]").otherwise(""), "p_brand", F.lit("[[tab2]]")).alias("t"))
    return windows.interleave(rows, "p_partkey", "t", r"\[\[\w+\]\]")


K6 = """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN [p_name, '[[fig1]]', p_brand, '[[tab2]]'] ELSE [p_name || p_brand, '[[tab2]]'] END AS parts FROM part)
SELECT p_partkey, CAST(i - 1 AS INT) AS position, parts[i] AS part FROM p, (SELECT range AS i FROM range(1, 5)) WHERE i <= len(parts)"""


def w12_scripts(spark: SparkSession, d: str) -> DataFrame:
    return windows.nearest_full_size(table(spark, d, "events"), "user_id", ["event_id"], F.col("value") > 100, "value").select("user_id", "event_id", "base")


W12 = """WITH e AS (SELECT user_id, event_id, CASE WHEN value > 100 THEN value END AS v FROM events)
SELECT user_id, event_id, coalesce(lag(v, 1) OVER w, lag(v, 2) OVER w, lag(v, 3) OVER w) AS base FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


def w17_grid(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample_grid(table(spark, d, "nation").select("n_nationkey"), 401).select("n_nationkey", "i", F.round("u", 9).alias("u"))


W17 = "SELECT n_nationkey, CAST(range AS INT) AS i, round(range / 400.0, 9)::DOUBLE AS u FROM nation, range(401)"


def t62_option_block(spark: SparkSession, d: str) -> DataFrame:
    """The box around a page's spans of a kind, if there are four."""
    return layout.block_box(table(spark, d, "lineitem").where("l_returnflag = 'N'"), ["l_orderkey"], "l_linenumber", "l_quantity")


T62 = "SELECT l_orderkey, min(l_quantity) AS y_min, max(l_quantity) AS y_max, count(*) AS n, min(l_linenumber) AS x_min, max(l_linenumber) AS x_max FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(*) >= 4"

QUERIES = {
    "m12_put_spec": (m12_put_spec, M12), "m15_put_outline": (m15_put_outline, M15), "m21_claim": (m21_claim, M21), "st4_sessions": (st4_sessions, ST4),
    "st6_sweep": (st6_sweep, ST6), "st7_log_lines": (st7_log_lines, ST7), "k6_interleave": (k6_interleave, K6), "w12_scripts": (w12_scripts, W12), "w17_grid": (w17_grid, W17), "t62_option_block": (t62_option_block, T62),
}
