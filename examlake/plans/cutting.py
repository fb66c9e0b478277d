"""Queries of anchors and cuts over texts made of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cuts
from ..sources.tables import LINE, table


def _type() -> Column:
    return F.when(F.col("l_returnflag") == "R", "单选题").when(F.col("l_returnflag") == "A", "填空题")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A part's lines as the questions of a paper: number, mark, type, points here and there, and as many letters as its price has thousands, times ten."""
    i = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", *LINE))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity", i.alias("i"), (F.floor(F.col("l_extendedprice") / 1000).cast("int") * 10 + 1).alias("long"))
    head = F.concat(F.col("i").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "、").otherwise(". "))
    kind = F.when(_type().isNull(), "").otherwise(F.concat(_type(), F.when(F.col("l_linestatus") == "F", "（4分）").otherwise("")))
    before = Window.partitionBy("l_partkey").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("begin", F.concat(head, kind)).withColumn("head", F.length(head)).withColumn("kind", F.length(kind))
    sized = sized.withColumn("n_chars", F.col("head") + F.col("kind") + F.when(F.col("long") < 0, 0).otherwise(F.col("long")) + 1)
    return sized.withColumn("start", F.coalesce(F.sum("n_chars").over(before), F.lit(0)).cast("int"))


def _documents(lines: DataFrame) -> DataFrame:
    """Texts; the number of questions is declared in every other one, and wrong in some of those."""
    line = lambda x: F.concat(x["begin"], F.repeat(F.lit("x"), x["long"]), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "begin", "long"))), line), "")
    per = lines.groupBy("l_partkey").agg(text.alias("text"), F.count("*").alias("n"), F.sum("n_chars").cast("int").alias("length"))
    return per.select("l_partkey", "text", "length", F.when(F.col("l_partkey") % 2 == 0, F.col("n") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)).alias("declared"))


_LINES = f"""o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, {", ".join(LINE)}) AS i, CAST(floor(l_extendedprice / 1000) AS INT) * 10 + 1 AS long FROM lineitem),
l AS (SELECT l_partkey, i, l_returnflag AS f, l_linestatus AS s, l_quantity AS q, long, length(CAST(i AS VARCHAR)) + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 2 END AS head, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'F' THEN 7 ELSE 3 END AS kind FROM o),
p AS (SELECT *, CAST(coalesce(sum(head + kind + long + 1) OVER (PARTITION BY l_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM l),
d AS (SELECT l_partkey, CAST(sum(head + kind + long + 1) AS INT) AS length, CASE WHEN l_partkey % 2 = 0 THEN count(*) + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END END AS declared FROM l GROUP BY 1)"""
#: scores of anchors ``a`` (l_partkey, scheme, pos, e, typed, pointed)
_SCORES = """t AS (SELECT *, greatest(0, coalesce(lead(pos) OVER (PARTITION BY l_partkey, scheme ORDER BY pos), length) - e) AS seg FROM a JOIN d USING (l_partkey)),
g AS (SELECT l_partkey, scheme, count(*) AS n, list_sort(list(seg)) AS v, count(*) FILTER (seg < 25) AS tiny, coalesce(stddev_pop(seg) / nullif(avg(seg), 0), 0) AS cv, (max(pos) - min(pos)) / greatest(any_value(length), 1) AS coverage, any_value(length) / 300.0 AS expected, any_value(declared) AS declared, bool_and(typed) AS typed, bool_and(pointed) AS pointed FROM t GROUP BY 1, 2),
r AS (SELECT l_partkey, scheme, n, v[len(v) // 2 + 1] AS median, tiny, coverage, -12.0 * coalesce(abs(n - declared), 0) + least(v[len(v) // 2 + 1], 300) / 150.0 - 8.0 * tiny - abs(n - expected) * CASE WHEN declared IS NULL THEN 0.8 ELSE 0.15 END - 2.0 * least(cv, 3) + 6.0 * coverage - CASE WHEN coverage < 0.4 THEN 15 ELSE 0 END - CASE WHEN n BETWEEN 4 AND 60 THEN 0 ELSE 25 END + CASE WHEN typed THEN 0.3 ELSE -4 END + CASE WHEN pointed THEN 0.5 ELSE 0 END AS score,
 CASE WHEN tiny > 0 THEN 'fragments' WHEN coverage < 0.6 THEN 'coverage' WHEN n <> declared THEN 'declared' WHEN declared IS NULL AND NOT n BETWEEN expected * 0.5 AND expected * 2 THEN 'length' END AS why FROM g)"""


def a10_anchor_score(spark: SparkSession, d: str) -> DataFrame:
    """Every line is an anchor of its text, with a type and points as it has them."""
    lines = _lines(spark, d)
    anchors = lines.select("l_partkey", F.col("start").alias("pos"), (F.col("start") + F.col("head")).alias("end"), _type().alias("type"), F.when((F.col("kind") == 7), 4).alias("points"))
    out = cuts.anchor_score(anchors, _documents(lines), ["l_partkey"])
    return out.select("l_partkey", "n", "median", "tiny", F.round("coverage", 9).alias("coverage"), F.round("score", 6).alias("score"), "confident", "why")


A10 = f"""WITH {_LINES}, a AS (SELECT l_partkey, 1 AS scheme, start AS pos, start + head AS e, f <> 'N' AS typed, kind = 7 AS pointed FROM p), {_SCORES}
SELECT l_partkey, n, median, tiny, round(coverage, 9)::DOUBLE AS coverage, round(score, 6)::DOUBLE AS score, why IS NULL AS confident, why FROM r"""


def a11_detect(spark: SparkSession, d: str) -> DataFrame:
    """All detectors over the texts; in the flow, lines stand in two margins and a few have room above."""
    lines = _lines(spark, d)
    y = -F.sum(F.when(F.col("l_quantity") > 25, 30).otherwise(10)).over(Window.partitionBy("l_partkey").orderBy("i"))
    flow = lines.select("l_partkey", F.col("i").alias("seq"), F.lit(1).alias("page"), F.when(F.col("l_linestatus") == "F", 60.0).otherwise(72.0).alias("x"), y.alias("y"), F.lit(10.5).alias("size"), "start", (F.col("start") + F.col("n_chars")).alias("end"))
    return cuts.detect(_documents(lines), flow, "l_partkey").withColumn("score", F.round("score", 6))


A11 = f"""WITH {_LINES}, y AS (SELECT *, CASE WHEN q > 25 THEN 30 ELSE 10 END AS gap, count(*) OVER (PARTITION BY l_partkey) AS k FROM p),
m AS (SELECT l_partkey, list_sort(list(gap)) AS v FROM y WHERE i > 1 GROUP BY 1),
h AS (SELECT y.*, CASE WHEN s = 'F' THEN '60' ELSE '72' END AS margin FROM y JOIN m USING (l_partkey) WHERE i > 1 AND k >= 8 AND gap >= 1.6 * v[len(v) // 2 + 1]),
a AS (SELECT l_partkey, 'type words with points' AS scheme, 0 AS rank, start + head AS pos, start + head + 7 AS e, true AS typed, true AS pointed FROM p WHERE kind = 7 AND l_partkey % 3 > 0
 UNION ALL SELECT l_partkey, 'type words', 1, start + head, start + head + 3, true, false FROM p WHERE kind > 0 AND l_partkey % 3 > 0
 UNION ALL SELECT l_partkey, 'arabic numbers', 2, start, start + head - CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END, false, false FROM y WHERE i <= 99 AND k >= 4
 UNION ALL SELECT l_partkey, 'typography 10.5/' || margin, 3, start, start + head + kind + long + 1, false, false FROM h QUALIFY count(*) OVER (PARTITION BY l_partkey, margin) >= 5),
{_SCORES}, z AS (SELECT r.*, CASE scheme WHEN 'type words with points' THEN 0 WHEN 'type words' THEN 1 WHEN 'arabic numbers' THEN 2 ELSE 3 END AS rank FROM r)
SELECT l_partkey, scheme, n, round(score, 6)::DOUBLE AS score, why IS NULL AS confident, why FROM z QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, rank, scheme) = 1"""


def a9_cut_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Orders are papers, their priorities' first letters sections, lines questions, suppliers figures."""
    lines = table(spark, d, "lineitem")
    questions = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("section"), (F.col("l_quantity") + 15).cast("int").alias("n_chars"), F.when(F.col("l_linestatus") == "F", "单选题").otherwise("解答题").alias("type"), (F.col("l_partkey") % 3 + 3).alias("n_options"), F.when(F.col("l_tax") > 0.07, "degraded").otherwise("ok").alias("quality"))
    sections = lines.groupBy("l_orderkey", F.col("l_returnflag").alias("label")).agg(F.max("l_linenumber").alias("declared"))
    assigned = lines.where("l_suppkey % 4 <> 0").select("l_orderkey", F.col("l_suppkey").alias("figure"), F.col("l_linenumber").alias("n"))
    return cuts.cut_warnings(sections, questions, assigned, lines.select("l_orderkey", F.col("l_suppkey").alias("figure")).distinct(), "l_orderkey")


A9 = """SELECT l_orderkey, 'section' AS kind, l_returnflag AS what, count(*) AS n FROM lineitem GROUP BY 1, 3 HAVING count(*) <> max(l_linenumber)
UNION ALL SELECT l_orderkey, 'short', CAST(l_linenumber AS VARCHAR), CAST(floor(l_quantity + 15) AS BIGINT) FROM lineitem WHERE floor(l_quantity + 15) < 20
UNION ALL SELECT l_orderkey, 'options', CAST(l_linenumber AS VARCHAR), l_partkey % 3 + 3 FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 3 <> 1
UNION ALL SELECT l_orderkey, 'degraded', CAST(l_linenumber AS VARCHAR), NULL FROM lineitem WHERE l_tax > 0.07
UNION ALL SELECT l_orderkey, 'shared', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT l_orderkey, 'orphan', CAST(l_suppkey AS VARCHAR), CAST(NULL AS BIGINT) FROM lineitem WHERE l_suppkey % 4 = 0"""


def a27_bright_band(spark: SparkSession, d: str) -> DataFrame:
    """Values of events, made flat for every ninth user."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("user_id") % 9 == 0, F.col("value") % 1 * 0.5).otherwise(F.col("value")).alias("v"))
    return cuts.longest_run(rows, "user_id", "event_id", "v")


A27 = """WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 9 = 0 THEN value % 1 * 0.5 ELSE value END AS v FROM events), b AS (SELECT user_id, event_id, user_id % 9 = 0 OR v > (max(v) OVER (PARTITION BY user_id) + min(v) OVER (PARTITION BY user_id)) / 2 AS bright FROM e),
r AS (SELECT user_id, event_id, bright, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, bright ORDER BY event_id) AS run FROM b),
g AS (SELECT user_id, run, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r WHERE bright GROUP BY 1, 2)
SELECT user_id, first, last, length FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1"""

QUERIES = {"a9_cut_warnings": (a9_cut_warnings, A9), "a10_anchor_score": (a10_anchor_score, A10), "a11_detect": (a11_detect, A11), "a27_bright_band": (a27_bright_band, A27)}
