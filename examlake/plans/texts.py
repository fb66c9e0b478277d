"""Queries of text, grading, predicates, markup and series over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups, series
from ..operators.rollup import final_answers
from ..sources.tables import FINAL_SQL, SHEETS_SQL, answers, sheets, table


def t18_clean_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(T.clean_stem(F.concat(F.lit("\n / \n"), F.col("text"), F.lit(" /")))).alias("stem_md5"))


T18 = r"""WITH a AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(chr(10) || ' / ' || chr(10) || text || ' /', '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g') AS t FROM conversations)
SELECT conv_id, turn, role, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*/\s*$', '', 'g'), '\s*/\s*$', ''), '^\s*/\s*', ''), '^\s+|\s+$', '', 'g')) AS stem_md5 FROM a"""


def t43_source_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of text and language, and the copies that share one."""
    docs = table(spark, d, "documents").select("doc_id", T.source_hash(F.col("lang"), F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


T43 = "SELECT sha256(lang || chr(1) || text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"


def p8_fresh(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    stored = table(spark, d, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("text")), 256).alias("digest"))
    return lookups.fresh_rows(docs, stored, ["doc_id", "digest"])


P8 = "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0"


def t46_question_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat((F.col("p_partkey") % 90).cast("string"), F.lit("（"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("）"))).when(F.col("p_partkey") % 4 == 1, F.lit("n/a")).otherwise((F.col("p_size")).cast("string"))
    n = T.question_number(raw)
    return table(spark, d, "part").select("p_partkey", n.alias("n"), T.show_number(n).alias("shown"))


T46 = """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 90 * 100 + p_size % 9 + 1 WHEN 1 THEN NULL ELSE p_size END AS n FROM part)
SELECT p_partkey, CAST(n AS INT) AS n, CASE WHEN n >= 100 THEN (n // 100) || '(' || (n % 100) || ')' ELSE CAST(n AS VARCHAR) END AS shown FROM r"""


def t65_duration(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).select("sheet_id", T.duration(F.col("sheet_id") % 9000).alias("took"))


T65 = "WITH s AS (SELECT o_orderkey AS sheet_id, o_orderkey % 9000 AS x FROM orders) SELECT sheet_id, CASE WHEN x < 60 THEN x || ' s' WHEN x < 3600 THEN x // 60 || ' min ' || x % 60 || ' s' ELSE x // 3600 || ' h ' || x % 3600 // 60 || ' min' END AS took FROM s"


def t72_safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


T72 = r"SELECT page_id, left(regexp_replace(regexp_replace(url, '[^\w.-]+', '_', 'g'), '^[_.]+', ''), 120) AS name FROM pages"


def w16_split_answers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as an answer zone ``1. R 2. A ...``, cut again; all or nothing where numbers repeat."""
    zone = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("z"))
    zone = zone.select("l_orderkey", F.array_join(F.transform("z", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(". "), x["l_returnflag"], F.lit("  \n"))), "").alias("zone"))
    cut = zone.select("l_orderkey", F.explode(T.split_answers(F.col("zone"), r"(\d+)\. ")).alias("a"))
    return cut.select("l_orderkey", F.col("a.n").alias("n"), F.col("a.text").alias("answer"))


W16 = "SELECT l_orderkey, l_linenumber AS n, l_returnflag AS answer FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"


def p3_find_page(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of page ids, with zeros and other endings, and the one that each is asked for."""
    i = F.col("page_id")
    path = F.concat(F.lit("paper/p-"), F.repeat(F.lit("0"), (i % 4).cast("int")), i.cast("string"), F.when(i % 5 == 0, ".PNG").when(i % 5 == 1, "").otherwise(".png"))
    return table(spark, d, "pages").where(T.page_path(path, F.when(i % 7 == 0, "other").otherwise("paper"), i + F.when(i % 3 == 0, 1).otherwise(0))).select("page_id", "url")


P3 = "SELECT page_id, url FROM pages WHERE page_id % 5 > 1 AND page_id % 7 > 0 AND page_id % 3 > 0"


def p18_filters(spark: SparkSession, d: str) -> DataFrame:
    return lookups.filter_counts(final_answers(answers(spark, d)), "sheet_id", {"all_": F.lit(True), **{v: F.col("verdict") == v for v in ("right", "wrong", "partial")}})


P18 = f"WITH {FINAL_SQL} SELECT sheet_id, count(*) AS all_, count(*) FILTER (verdict = 'right') AS \"right\", count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'partial') AS \"partial\" FROM final GROUP BY 1"


def e4_finiteness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("x", F.try_divide(F.col("value"), F.col("user_id") % 3 - 1))
    return series.finiteness(rows, "user_id", "x")


E4 = "SELECT user_id, count(*) AS n, count(*) FILTER (user_id % 3 = 1) AS n_bad FROM events GROUP BY 1"


def e8_interpolate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("u"), "value")
    at = (F.min("u").over(Window.partitionBy("user_id")) + F.max("u").over(Window.partitionBy("user_id"))) / 2
    return series.interpolate(rows, "user_id", "u", "value", at).select("user_id", F.round("value", 6).alias("value"))


E8 = """WITH s AS (SELECT user_id, CAST(event_id AS DOUBLE) AS u, value, lead(CAST(event_id AS DOUBLE)) OVER w AS u1, lead(value) OVER w AS v1, (min(event_id) OVER (PARTITION BY user_id) + max(event_id) OVER (PARTITION BY user_id)) / 2.0 AS mid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(value + (v1 - value) * (mid - u) / (u1 - u), 6) AS value FROM s WHERE u <= mid AND mid < u1"""

QUERIES = {
    "t18_clean_stem": (t18_clean_stem, T18),
    "t43_source_hash": (t43_source_hash, T43), "t46_question_numbers": (t46_question_numbers, T46), "t65_duration": (t65_duration, T65), "t72_safe_name": (t72_safe_name, T72),
    "w16_split_answers": (w16_split_answers, W16), "p3_find_page": (p3_find_page, P3), "p8_fresh": (p8_fresh, P8), "p18_filters": (p18_filters, P18),
    "e4_finiteness": (e4_finiteness, E4), "e8_interpolate": (e8_interpolate, E8),
}
