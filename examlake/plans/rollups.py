"""Queries of roll-ups and joins over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, lookups, rollup
from ..sources.tables import ANSWERS_SQL, FINAL_SQL, PAPERS_SQL, SHEETS_SQL, answers, papers, sheets, table

AS_OF = "2000-01-01 00:00:00"


def a2_list_sheets(spark: SparkSession, d: str) -> DataFrame:
    return rollup.list_sheets(sheets(spark, d), rollup.final_answers(answers(spark, d)))


A2 = f"""WITH {SHEETS_SQL}, {FINAL_SQL}
SELECT s.sheet_id, any_value(s.paper_id) AS paper_id, count(a.n) AS n_answers, count(*) FILTER (a.verdict = 'wrong') AS n_wrong, count(*) FILTER (a.verdict = 'partial') AS n_partial,
 CAST(coalesce(sum(CASE WHEN a.verdict = 'right' THEN 0 ELSE a.score_full - a.score_got END), 0) AS DOUBLE) AS lost
FROM sheets s LEFT JOIN final a USING (sheet_id) GROUP BY s.sheet_id"""


def a7_weak_spots(spark: SparkSession, d: str) -> DataFrame:
    """Topics are part brands, grouped by the owner of the paper."""
    rows = rollup.final_answers(answers(spark, d)).join(sheets(spark, d).select("sheet_id", "paper_id"), "sheet_id").join(papers(spark, d).select("paper_id", "owner_id"), "paper_id")
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("topic"))
    return rollup.weak_spots(rows.join(brand, "part_id"), "topic", ["owner_id"])


A7 = f"""WITH {PAPERS_SQL}, {SHEETS_SQL}, {FINAL_SQL},
g AS (SELECT owner_id, p_brand AS topic, sum(score_full - score_got) AS lost, count(*) AS n FROM final JOIN sheets USING (sheet_id) JOIN papers USING (paper_id) JOIN part ON p_partkey = part_id WHERE score_full > score_got GROUP BY ALL)
SELECT owner_id, topic, CAST(lost AS DOUBLE) AS lost, n, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY lost DESC, topic) AS INT) AS rank FROM g QUALIFY rank <= 3"""

#: what a lineitem counts as, for the roll-up of progress
_COUNTS = {
    "questions": "true", "solved": "l_returnflag <> 'A'", "failed": "l_returnflag = 'A' AND l_linestatus = 'F'", "labels": "l_returnflag <> 'A' AND l_quantity > 2",
    "picked": "l_returnflag <> 'A' AND l_quantity > 4", "specs": "l_returnflag <> 'A' AND l_quantity > 6", "drafts": "l_returnflag = 'N' AND l_quantity > 45", "tried": "l_returnflag <> 'A' AND l_quantity > 8",
}


def a1_progress(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sheet_id")
    return rollup.progress(sheets(spark, d), lines, "sheet_id", {n: F.expr(c) for n, c in _COUNTS.items()}, "l_shipdate", F.lit(AS_OF).cast("timestamp"))


A1 = (
    f"WITH {SHEETS_SQL}, p AS (SELECT sheet_id, "
    + ", ".join(f"(SELECT count(*) FROM lineitem WHERE l_orderkey = sheet_id AND {c}) AS {n}" for n, c in _COUNTS.items())
    + ", greatest((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = sheet_id), created_at) AS last_change FROM sheets) "
    + f"SELECT *, date_diff('second', last_change, TIMESTAMP '{AS_OF}') AS idle_seconds, date_diff('second', last_change, TIMESTAMP '{AS_OF}') < 180 AS busy FROM p"
)


def a3_list_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their sheets, those that are done, their answers, and the latest sheet."""
    s = sheets(spark, d)
    lines = answers(spark, d).select("sheet_id").join(s.select("sheet_id", "paper_id"), "sheet_id")
    return lookups.list_papers(papers(spark, d).select("paper_id", "name"), {"n_sheets": s, "n_done": s.where("status = 'F'"), "n_answers": lines}, "paper_id", [F.max("created_at")])


A3 = f"""WITH {PAPERS_SQL}, {SHEETS_SQL}
SELECT paper_id, name, (SELECT count(*) FROM sheets s WHERE s.paper_id = p.paper_id) AS n_sheets, (SELECT count(*) FROM sheets s WHERE s.paper_id = p.paper_id AND status = 'F') AS n_done,
 (SELECT count(*) FROM sheets s JOIN lineitem ON l_orderkey = sheet_id WHERE s.paper_id = p.paper_id) AS n_answers, (SELECT max(created_at) FROM sheets s WHERE s.paper_id = p.paper_id) AS updated_at FROM papers p"""


def a4_stat(spark: SparkSession, d: str) -> DataFrame:
    return lookups.stat({n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "part", "documents", "events")})


A4 = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("customer", "orders", "lineitem", "part", "documents", "events"))


def a6_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Assembled when the order was placed; its lines of two kinds and a fixed day are the parts that may have changed."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("r"), F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("a"))
    f = lookups.freshness(F.col("created_at"), F.col("r"), F.col("a"), F.to_timestamp(F.lit("1995-01-01 00:00:00")))
    return sheets(spark, d).join(per, "sheet_id", "left").select("sheet_id", f.alias("f")).select("sheet_id", "f.changed", "f.fresh")


A6 = f"""WITH {SHEETS_SQL}, c AS (SELECT sheet_id, created_at, greatest((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = sheet_id AND l_returnflag = 'R'), (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = sheet_id AND l_returnflag = 'A'), TIMESTAMP '1995-01-01') AS changed FROM sheets)
SELECT sheet_id, changed, created_at >= changed AS fresh FROM c"""


def a15_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Lines are boxes, documents of one source are pages: lines on more than a fiftieth would be few, so half of three."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), (F.col("l_orderkey") % 7).alias("page"), "l_linenumber", "l_returnflag")
    return rollup.boilerplate(rows, "page", ["l_linenumber", "l_returnflag"], ["doc"])


A15 = """WITH r AS (SELECT l_orderkey % 50 AS doc, l_orderkey % 7 AS page, l_linenumber, l_returnflag FROM lineitem), p AS (SELECT doc, count(DISTINCT page) AS n_pages FROM r GROUP BY 1)
SELECT doc, l_linenumber, l_returnflag, count(DISTINCT page) AS n_on, any_value(n_pages) AS n_pages FROM r JOIN p USING (doc) GROUP BY 1, 2, 3 HAVING count(DISTINCT page) * 2 > any_value(n_pages)"""


def a17_const_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("key"), F.floor(F.col("l_tax") * 5).alias("v"))
    return rollup.constant_keys(rows, "case_id", "key", "v")


A17 = """WITH g AS (SELECT l_suppkey, CAST(l_linenumber AS VARCHAR) AS key, max(floor(l_tax * 5)) = min(floor(l_tax * 5)) AS flat FROM lineitem GROUP BY 1, 2)
SELECT key, bool_and(flat) AS constant, count(*) AS n_cases FROM g GROUP BY 1"""


def a20_run_report(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return rollup.run_report(log, "user_id", "event_id", "event_type")


A20 = "SELECT user_id, count(*) AS rounds, arg_min(event_type, event_id) AS first_verdict, arg_max(event_type, event_id) AS final_verdict FROM events GROUP BY 1"


def a21_stats(spark: SparkSession, d: str) -> DataFrame:
    return lookups.section_stats(table(spark, d, "part"), F.when(F.col("p_size") > 40, F.col("p_type")), F.col("p_brand"), "p_size")


A21 = "SELECT coalesce(CASE WHEN p_size > 40 THEN p_type END, p_brand, '...') AS section, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS points, CAST(round(sum(p_size) * 0.75) AS BIGINT) AS minutes FROM part GROUP BY 1"


def a23_full_score(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).withColumn("score_full", F.when(F.col("n") != 5, F.col("score_full")))
    return rollup.full_score(rows, "sheet_id")


A23 = f"WITH {ANSWERS_SQL} SELECT sheet_id, CAST(CASE WHEN count(*) FILTER (n = 5) = 0 AND sum(score_full) > 0 THEN sum(score_full) END AS DOUBLE) AS full_score FROM answers GROUP BY 1"


def a26_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Nations are entries, regions chapters."""
    entries = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return lookups.chapters(table(spark, d, "region").select("r_name"), entries, "r_name", "n_nationkey", ("EUROPE", "ASIA", "AMERICA", "AFRICA", "MIDDLE EAST"))


A26 = "SELECT r_name, count(n_nationkey) AS n, CAST(coalesce(list_position(['EUROPE', 'ASIA', 'AMERICA', 'AFRICA', 'MIDDLE EAST'], r_name), 0) AS BIGINT) AS position FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"


def a29_seam(spark: SparkSession, d: str) -> DataFrame:
    return lookups.seam(table(spark, d, "events"), "user_id", "event_id", "value").withColumn("median", F.round("median", 6))


A29 = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, (min(struct_pack(value, event_id)) FILTER (k * 3 > n AND k * 3 <= 2 * n)).event_id AS at, round(median(value), 6) AS median, median(value) - min(value) FILTER (k * 3 > n AND k * 3 <= 2 * n) >= 40 AS seam FROM e GROUP BY 1"""


def j1_get_paper(spark: SparkSession, d: str) -> DataFrame:
    return joins.nested(papers(spark, d).select("paper_id", "name"), sheets(spark, d), "paper_id", ["sheet_id"], ["sheet_id", "status"])


J1 = f"WITH {PAPERS_SQL}, {SHEETS_SQL} SELECT paper_id, name, coalesce((SELECT string_agg(sheet_id || ':' || status, '|' ORDER BY sheet_id) FROM sheets s WHERE s.paper_id = p.paper_id), '') AS items FROM papers p"


def j2_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Each sheet with its latest line, and whether that has a supplier in the books; missing is 0."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sheet_id")
    latest = lookups.with_latest(sheets(spark, d).select("sheet_id"), lines, "sheet_id", ["l_shipdate", "l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"])
    sup = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("ok"))
    return latest.join(sup, "l_suppkey", "left").select("sheet_id", F.col("l_partkey").alias("part_id"), F.coalesce("ok", F.lit(0)).alias("n_ok"))


J2 = f"""WITH {SHEETS_SQL}, m AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT sheet_id, l_partkey AS part_id, CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS n_ok FROM sheets LEFT JOIN m ON l_orderkey = sheet_id LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0"""


def j4_missing(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id")).agg(F.max("l_tax").alias("label"))
    return joins.missing(sheets(spark, d).select("sheet_id"), per, "sheet_id", F.col("label") < 0.05)


J4 = "SELECT count(*) FILTER (m IS NULL OR m < 0.05) AS n_missing, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, max(l_tax) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


def j6_orphan_objects(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "lineitem").select(F.col("l_partkey").alias("object_id"), F.col("l_orderkey").alias("sheet_id"))
    targets = sheets(spark, d).join(papers(spark, d).where("kind <> 'BUILDING'"), "paper_id", "left_semi")
    return joins.orphan_objects(assets, targets, "object_id", "sheet_id")


J6 = """WITH t AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING')
SELECT DISTINCT l_partkey AS object_id FROM lineitem a WHERE l_orderkey IN (SELECT o_orderkey FROM t) AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_orderkey NOT IN (SELECT o_orderkey FROM t))"""


def j7_latest_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_nonempty(papers(spark, d), sheets(spark, d), answers(spark, d))


J7 = f"""WITH {PAPERS_SQL}, {SHEETS_SQL} SELECT paper_id, (SELECT sheet_id FROM sheets s WHERE s.paper_id = p.paper_id AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = sheet_id) ORDER BY created_at DESC, sheet_id DESC LIMIT 1) AS latest_sheet FROM papers p"""


def j14_section_of(spark: SparkSession, d: str) -> DataFrame:
    """The last login-like event (type of the smallest name) at or before each other one of the same user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    marks = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("section"))
    return joins.as_of(e.where("event_type <> 'click'").select("user_id", "event_id"), marks, ["user_id"], "event_id", "section")


J14 = "SELECT a.user_id, a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.event_id <= a.event_id) AS section FROM events a WHERE event_type <> 'click'"


def j20_figures_of(spark: SparkSession, d: str) -> DataFrame:
    """Points are orders at their price, intervals ten-thousand wide steps of every third price level."""
    points = sheets(spark, d).select("sheet_id", F.col("status").alias("page"), F.floor("total").alias("at"))
    steps = points.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("box"))
    steps = steps.select("page", "box", (F.col("box") * 9000).alias("low"), (F.col("box") * 9000 + 4000).alias("high"))
    return joins.inside(points, steps, ["page"], "at", "low", "high", 5000).select("sheet_id", "box")


J20 = "SELECT o_orderkey AS sheet_id, r.box FROM orders JOIN (SELECT range AS box, range * 9000 AS low, range * 9000 + 4000 AS high FROM range(60)) r ON floor(CAST(o_totalprice AS DECIMAL(18,2))) >= low AND floor(CAST(o_totalprice AS DECIMAL(18,2))) < high"


def s18_alias_dim(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a vocabulary, with a lower-cased other name, and how often each alias stands."""
    n = table(spark, d, "nation").withColumn("code", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    dim = joins.alias_dimension(n, "code", "n_name", F.array(F.lower("n_name")))
    return dim.withColumn("n_same", F.count("*").over(Window.partitionBy("alias")))


S18 = "WITH v AS (SELECT DISTINCT 'N' || n_nationkey AS code, unnest(['N' || n_nationkey, n_name, lower(n_name)]) AS alias FROM nation) SELECT code, alias, count(*) OVER (PARTITION BY alias) AS n_same FROM v"

QUERIES = {
    "a1_progress": (a1_progress, A1), "a2_list_sheets": (a2_list_sheets, A2), "a3_list_papers": (a3_list_papers, A3), "a4_stat": (a4_stat, A4), "a6_assembled": (a6_assembled, A6),
    "a7_weak_spots": (a7_weak_spots, A7), 
    "a15_boilerplate": (a15_boilerplate, A15), "a17_const_keys": (a17_const_keys, A17), "a20_run_report": (a20_run_report, A20), "a21_stats": (a21_stats, A21),
    "a23_full_score": (a23_full_score, A23), "a26_chapters": (a26_chapters, A26), "a29_seam": (a29_seam, A29), 
    "j1_get_paper": (j1_get_paper, J1), "j2_solutions": (j2_solutions, J2), "j4_missing": (j4_missing, J4), "j6_orphan_objects": (j6_orphan_objects, J6), "j7_latest_nonempty": (j7_latest_nonempty, J7),
    "j14_section_of": (j14_section_of, J14), "j20_figures_of": (j20_figures_of, J20), "s18_alias_dim": (s18_alias_dim, S18),
}
