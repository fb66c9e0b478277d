"""Queries of layout and of further text operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, lookups
from ..sources.tables import table


def s1_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select((F.col("user_id")).alias("page"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 1).alias("text"), F.lit(10.0).alias("size"), (F.floor(F.col("value") / 60) * 1.0).alias("y"), (F.col("event_id") % 7 * 2.0).alias("x"))
    return layout.merge_runs(c.withColumn("x1", F.col("x") + 2), "page")


S1 = """WITH c AS (SELECT user_id AS page, event_id AS seq, event_type[1] AS t, floor(value / 60) AS y, event_id % 7 * 2.0 AS x, event_id % 7 * 2.0 + 2 AS x1 FROM events),
m AS (SELECT *, CASE WHEN coalesce(abs(y - lag(y) OVER w) < 0.8 AND x - lag(x1) OVER w BETWEEN -0.6 AND 4.5, false) THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY page ORDER BY seq)),
r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY seq) AS run FROM m)
SELECT page, CAST(run AS BIGINT) AS run, string_agg(t, '' ORDER BY seq) AS text, CAST(min(x) AS DOUBLE) AS x, CAST(max(x1) AS DOUBLE) AS x1, min(y) AS y FROM r GROUP BY 1, 2"""


def a13_body_size(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.floor(F.col("value") / 10).cast("double").alias("size"), "event_id")
    return layout.mode_first(rows, "user_id", "size", "event_id", F.lit(14.0))


A13 = "WITH g AS (SELECT user_id, floor(value / 10) AS size, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, size FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"


def j15_carry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.max("l_linenumber").alias("n"))
    return layout.carry_over(rows, "l_orderkey", ["l_shipdate"], "n")


J15 = "WITH g AS (SELECT l_orderkey, l_shipdate, max(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) SELECT *, max(n) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM g"


def j16_scenes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    papers = docs.select(F.col("doc_id").alias("paper"), F.lit(1).alias("n"), F.col("text").alias("stem"))
    stored = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("paper"), F.lit(1).alias("n"), F.lit("db").alias("scene"))
    files = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("paper"), F.lit(1).alias("n"), F.lit("file").alias("scene"), F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 40)).otherwise(F.lit("zzzz not in any stem")).alias("excerpt"))
    return layout.scenes_of(papers, stored, files)


J16 = "SELECT doc_id AS paper, CAST(1 AS INT) AS n, CASE WHEN doc_id % 3 = 0 THEN 'db' ELSE 'file' END AS scene FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0"


def j17_link_tables(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are documents and turns pages; a table spans each turn but every fifth."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("page")).agg(F.min(F.length("text")).alias("k"))
    tables = c.where("page % 5 <> 4").select("doc", "page", (F.col("page") * 10).alias("tid"), F.lit(10.0).alias("x0"), (F.lit(100.0) + F.when(F.col("k") % 3 == 0, 20).otherwise(0)).alias("x1"), F.lit(50.0).alias("y0"), F.lit(90.0).alias("y1"))
    body = c.where("k % 4 = 0").select("doc", "page", F.lit(95.0).alias("y"))
    return layout.link_continuations(tables, body)


J17 = """WITH RECURSIVE c AS (SELECT conv_id AS doc, turn AS page, min(length(text)) AS k FROM conversations GROUP BY 1, 2),
t AS (SELECT doc, page, page * 10 AS tid, CASE WHEN k % 3 = 0 THEN 120 ELSE 100 END AS x1, k % 4 = 0 AS body FROM c WHERE page % 5 <> 4),
r AS (SELECT a.doc, a.tid, a.page, a.x1, CASE WHEN b.tid IS NOT NULL AND NOT a.body THEN b.tid END AS parent FROM t a LEFT JOIN t b ON b.doc = a.doc AND b.page = a.page - 1 AND abs(a.x1 - b.x1) <= 4),
f AS (SELECT doc, tid, tid AS root FROM r WHERE parent IS NULL UNION ALL SELECT r.doc, r.tid, f.root FROM r JOIN f ON f.doc = r.doc AND f.tid = r.parent)
SELECT doc, tid, root FROM f"""


def j18_place_figures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), "event_type", "value")
    figures = e.where("event_type = 'purchase'").select(F.col("seq").alias("figure"), "page", F.col("value").alias("top"))
    return layout.place_figures(figures, e.where("event_type <> 'purchase'").withColumnRenamed("value", "y")).select("figure", "page", "before")


J18 = "SELECT event_id AS figure, user_id AS page, (SELECT min(s.event_id) FROM events s WHERE s.user_id = f.user_id AND s.event_type <> 'purchase' AND s.value <= f.value) AS before FROM events f WHERE event_type = 'purchase'"


def j19_fold_tables(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), (F.col("event_id") % 100 * 1.0).alias("x"), F.col("value").alias("y"))
    boxes = table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("page"), F.col("n_nationkey").alias("tid"), F.lit(10.0).alias("x0"), F.lit(60.0).alias("x1"), F.lit(5.0).alias("y0"), (F.col("n_nationkey") * 4.0).alias("y1"))
    return layout.fold_tables(e, boxes).select("page", "tid", "seq")


J19 = """SELECT user_id AS page, n_nationkey AS tid, event_id AS seq FROM events JOIN nation ON user_id = n_nationkey * 3 WHERE event_id % 100 BETWEEN 10 AND 60 AND value BETWEEN 5 AND n_nationkey * 4.0 QUALIFY count(*) OVER (PARTITION BY user_id, n_nationkey) >= 3"""


def j25_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("id")).agg(F.max("l_quantity").alias("x"), F.max("l_tax").alias("t")).select("l_orderkey", "id", "x", (F.col("t") * 100).alias("y"), F.lit(8.0).alias("w"), F.lit(6.0).alias("h"))
    return layout.overlaps(rows, "l_orderkey").withColumn("depth", F.round("depth", 6))


J25 = """WITH b AS (SELECT l_orderkey AS f, l_linenumber AS id, max(l_quantity) AS x, max(l_tax) * 100 AS y FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.id AS a_id, b.id AS b_id, least(least(a.x, b.x) + 8 - greatest(a.x, b.x), least(a.y, b.y) + 6 - greatest(a.y, b.y)) AS depth FROM b a JOIN b USING (f) WHERE a.id < b.id),
g AS (SELECT a_id, b_id, max(depth) AS depth FROM p WHERE depth > 0 GROUP BY 1, 2)
SELECT a_id, b_id, round(depth, 6) AS depth, CASE WHEN depth >= 5 THEN 'fail' WHEN depth >= 2.5 THEN 'warn' ELSE 'ok' END AS level FROM g"""


def w2_typography(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 40).alias("left"))
    return layout.typography(rows, "user_id", ["event_id"], "value", "left", least=2)


W2 = """WITH g AS (SELECT user_id, event_id, event_id % 40 AS l, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap FROM events),
k AS (SELECT user_id, list_sort(list(gap)) AS v FROM g WHERE gap IS NOT NULL GROUP BY 1), m AS (SELECT user_id, v[CAST(floor(len(v) / 2) AS INT) + 1] AS median FROM k),
c AS (SELECT user_id, CAST(floor(l / 6) * 6 AS BIGINT) AS margin, count(*) AS n FROM g JOIN m USING (user_id) WHERE gap >= 1.6 * median GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, margin, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, margin) AS INT) AS rank FROM c QUALIFY rank <= 3"""


def w14_y_bounds(spark: SparkSession, d: str) -> DataFrame:
    return layout.y_bounds(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_quantity")


W14 = "SELECT l_orderkey, l_returnflag, min(l_quantity) AS y_min, max(l_quantity) AS y_max FROM lineitem GROUP BY 1, 2"


def t64_intervals(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 4 + F.col("l_linenumber") * 2).alias("y1"))
    return layout.connected_intervals(rules, "l_orderkey", "y0", "y1")


T64 = """WITH r AS (SELECT l_orderkey, l_quantity AS y0, l_quantity + 4 + l_linenumber * 2 AS y1 FROM lineitem),
n AS (SELECT *, CASE WHEN y0 + 4 < max(y1) OVER (PARTITION BY l_orderkey ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM r),
g AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT l_orderkey, CAST(k AS BIGINT) AS "group", min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM g GROUP BY 1, 2"""


def t19_split_options(spark: SparkSession, d: str) -> DataFrame:
    """Options in order, by columns, marked in another way, and not all there."""
    p, k = F.col("p_name"), F.col("p_partkey") % 5
    stem = (
        F.when(k == 0, p)
        .when(k == 1, F.concat(p, F.lit(" A. one B. two C. three D. "), F.col("p_brand"), F.lit(" /")))
        .when(k == 2, F.concat(p, F.lit(" A. one C. three B. two D. four")))
        .when(k == 3, F.concat(p, F.lit(" A、one B、two C、three D、four")))
        .otherwise(F.concat(p, F.lit(" B. x A. one B. two C. three D. four")))
    )
    return table(spark, d, "part").select("p_partkey", T.split_options(stem).alias("o")).select("p_partkey", "o.body", F.array_join("o.options", "|").alias("options"))


T19 = """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN p_name || ' B. x' ELSE p_name END AS body, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'one|two|three|' || p_brand ELSE 'one|two|three|four' END AS options FROM part"""


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一丁七万三上下不与专且世丘业丛东丝丢两严丧个中丰临"


def t35_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents with letters made ideographs, against readings that lack an end, have other characters, or lack a block."""
    text, n = F.translate("text", _LATIN, _HAN + "丸"), F.length("text")
    k = F.col("doc_id") % 4
    read = F.when(k == 0, F.left(text, F.floor(n * 0.7).cast("int"))).when(k == 1, F.translate(text, _HAN[:8], "丹" * 8)).otherwise(text)
    blocks = F.array(F.struct(n.alias("source"), F.when(k == 2, F.floor(n / 2)).otherwise(n).cast("int").alias("read")))
    return table(spark, d, "documents").select("doc_id", T.coverage_note(text, read, blocks).alias("note"))


T35 = f"""WITH t AS (SELECT doc_id, translate(text, '{_LATIN}', '{_HAN}丸') AS t, length(text) AS n FROM documents),
r AS (SELECT doc_id, n, t AS a, CASE doc_id % 4 WHEN 0 THEN left(t, CAST(floor(n * 0.7) AS INT)) WHEN 1 THEN translate(t, '{_HAN[:8]}', '{"丹" * 8}') ELSE t END AS b FROM t),
c AS (SELECT doc_id, n, regexp_replace(a, '[^一-鿿]', '', 'g') AS a, regexp_replace(b, '[^一-鿿]', '', 'g') AS b FROM r)
SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND n > 0 AND n // 2 < 0.8 * n THEN 'blocks' WHEN length(b) < 0.85 * greatest(length(a), 1) THEN 'short'
 WHEN len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / greatest(len(list_filter(list_distinct(string_split(a, '')), lambda x: x <> '')), 1) < 0.75 THEN 'different' END AS note FROM c"""


def t36_first_object(spark: SparkSession, d: str) -> DataFrame:
    """The k of the JSON in events' properties, with words around it."""
    o = T.first_object(F.concat(F.lit("here: "), F.col("props"), F.lit(" done")), "k long")
    return table(spark, d, "events").select("event_id", o["k"].alias("k"))


T36 = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def t61_progress(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_id") % 4 == 0, "no numbers").otherwise(F.concat(F.lit("page "), (F.col("event_id") % 9).cast("string"), F.lit("/12")))
    p = T.progress_of(line)
    return table(spark, d, "events").groupBy("user_id").agg(F.max(p["done"]).alias("done"), F.max(p["total"]).alias("total"))


T61 = r"""WITH l AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'no numbers' ELSE 'page ' || event_id % 9 || '/12' END AS line FROM events), r AS (SELECT user_id, regexp_extract(line, '(\d+)\s*/\s*(\d+)', 1) AS a, regexp_extract(line, '(\d+)\s*/\s*(\d+)', 2) AS b FROM l)
SELECT user_id, max(TRY_CAST(a AS INT)) AS done, max(TRY_CAST(b AS INT)) AS total FROM r GROUP BY 1"""


def t66_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.payload([(F.col("text"), 260), (F.col("lang"), 200), (F.when(F.col("doc_id") % 2 == 0, F.col("source")), 400)])).alias("payload_md5"))


T66 = "SELECT doc_id, md5(concat_ws(chr(10), nullif(left(text, 260), ''), lang, CASE WHEN doc_id % 2 = 0 THEN source END)) AS payload_md5 FROM documents"


def p6_free_name(spark: SparkSession, d: str) -> DataFrame:
    """For each brand, the smallest number from 2 that no part size of it has: ``brand (k)``; the bare name if free."""
    p = table(spark, d, "part").select("p_brand", F.col("p_size").alias("k"))
    free = lookups.free_names(p, p, "p_brand", "k")
    return free.select("p_brand", F.format_string("%s (%d)", "p_brand", "k").alias("name"))


P6 = """SELECT b.p_brand, b.p_brand || ' (' || min(k) || ')' AS name FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT range AS k FROM range(2, 61)) r
WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = b.p_brand AND q.p_size = k) GROUP BY 1"""

QUERIES = {
    "s1_merge_runs": (s1_merge_runs, S1), "a13_body_size": (a13_body_size, A13), "j15_carry": (j15_carry, J15), "j16_scenes": (j16_scenes, J16), "j17_link_tables": (j17_link_tables, J17), "j18_place_figures": (j18_place_figures, J18),
    "j19_fold_tables": (j19_fold_tables, J19), "j25_overlaps": (j25_overlaps, J25), "w2_typography": (w2_typography, W2), "w14_y_bounds": (w14_y_bounds, W14), "t64_intervals": (t64_intervals, T64), 
    "t19_split_options": (t19_split_options, T19), "t35_coverage": (t35_coverage, T35), "t36_first_object": (t36_first_object, T36), "t61_progress": (t61_progress, T61), "t66_payload": (t66_payload, T66), "p6_free_name": (p6_free_name, P6),
}
