"""Queries of grading over tables of answers and the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grading as G
from ..operators.lookups import each_once
from ..operators.rollup import final_answers
from ..sources.tables import FINAL_SQL, answers, table

def _of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of parts: sizes with and without units, in other spellings, sizes of another part, and letters of its brand."""
    student = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || '.0 m/s' WHEN 2 THEN p_size || 'e1' WHEN 3 THEN translate(right(p_brand, 1), '12345', 'ABCDA') || ' C' WHEN 4 THEN p_name ELSE '' END"
    ref = "CASE p_partkey % 6 WHEN 0 THEN (p_size + p_partkey % 2) || 'kg' WHEN 1 THEN p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' m/s' END WHEN 2 THEN (p_size * 10 + p_partkey % 4 % 2) || '' WHEN 3 THEN 'AC' WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE upper(p_name) || '!' END ELSE 'A' END"
    return table(spark, d, "part").select("p_partkey", F.expr(student).alias("student"), F.expr(ref).alias("ref"))


def t13_grade(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and reasons of answers made of parts."""
    graded = each_once(_of_parts(spark, d), ["student", "ref"], G.judge(F.col("student"), F.col("ref")), "j")
    return graded.select("p_partkey", "j.verdict", "j.why")


T13 = r"""WITH a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || '.0 m/s' WHEN 2 THEN p_size || 'e1' WHEN 3 THEN translate(right(p_brand, 1), '12345', 'ABCDA') || ' C' WHEN 4 THEN p_name ELSE '' END AS s,
 CASE p_partkey % 6 WHEN 0 THEN (p_size + p_partkey % 2) || 'kg' WHEN 1 THEN p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' m/s' END WHEN 2 THEN (p_size * 10 + p_partkey % 4 % 2) || '' WHEN 3 THEN 'AC' WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE upper(p_name) || '!' END ELSE 'A' END AS r FROM part),
n AS (SELECT *, TRY_CAST(regexp_extract(s, '^\d+(\.\d+)?(e\d+)?') AS DOUBLE) AS sv, TRY_CAST(regexp_extract(r, '^\d+(\.\d+)?(e\d+)?') AS DOUBLE) AS rv, regexp_replace(regexp_replace(s, '^\d+(\.\d+)?(e\d+)?', ''), '\s', '', 'g') AS su, regexp_replace(regexp_replace(r, '^\d+(\.\d+)?(e\d+)?', ''), '\s', '', 'g') AS ru,
 regexp_replace(upper(s), '[\s!]', '', 'g') AS sw, regexp_replace(upper(r), '[\s!]', '', 'g') AS rw FROM a)
SELECT p_partkey, CASE WHEN s = '' THEN NULL WHEN sv IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN sv <> rv THEN 'wrong' WHEN su = ru THEN 'right' END WHEN regexp_full_match(sw, '[ABCD]+') THEN CASE WHEN list_sort(list_distinct(string_split(sw, ''))) = list_sort(list_distinct(string_split(rw, ''))) THEN 'right' ELSE 'wrong' END WHEN sw = rw THEN CASE WHEN s = r THEN 'right' ELSE 'wrong' END ELSE 'wrong' END AS verdict,
 CASE WHEN s = '' THEN 'nothing on one side' WHEN sv IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN sv <> rv THEN 'other number' WHEN su = ru THEN 'same number and unit' ELSE 'same number, other unit' END WHEN regexp_full_match(sw, '[ABCD]+') THEN CASE WHEN list_sort(list_distinct(string_split(sw, ''))) = list_sort(list_distinct(string_split(rw, ''))) THEN 'same letters' ELSE 'other letters' END WHEN s = r THEN 'same formula' ELSE 'other formula or words' END AS why FROM n"""


def t14_answers_agree(spark: SparkSession, d: str) -> DataFrame:
    """Sizes with units against sizes of the neighbouring part, with a unit left out here and there."""
    p = table(spark, d, "part")
    a = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.lit(" kg")))
    b = F.concat((F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(".0kg"))
    pairs = p.select("p_partkey", a.alias("a"), b.alias("b"))
    return each_once(pairs, ["a", "b"], G.answers_agree(F.col("a"), F.col("b")), "agree").select("p_partkey", "agree")


T14 = r"""WITH t AS (SELECT p_partkey, p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' kg' END AS a, (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) || '.0kg' AS b FROM part),
n AS (SELECT p_partkey, CAST(regexp_extract(a, '^[\d.]+') AS DOUBLE) AS av, CAST(regexp_extract(b, '^[\d.]+') AS DOUBLE) AS bv, trim(regexp_replace(a, '^[\d.]+', '')) AS au, trim(regexp_replace(b, '^[\d.]+', '')) AS bu FROM t)
SELECT p_partkey, CASE WHEN av <> bv THEN false WHEN au = bu THEN true END AS agree FROM n"""


def t3_norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(G.norm_text(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("norm"), G.wordy(F.col("text")).alias("wordy"))


T3 = r"SELECT doc_id, md5(regexp_replace(upper(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[\s,;:!?()\[\]]+', '', 'g')) AS norm, NOT regexp_matches(text, '[A-Za-z]') AS wordy FROM documents"


def t4_choice(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.translate(F.col("p_size").cast("string"), "0123456789", "ABCDDCBAEb"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" c")).otherwise(F.lit("")))
    return table(spark, d, "part").select("p_partkey", G.as_choice(raw).alias("choice"))


T4 = """WITH r AS (SELECT p_partkey, upper(translate(CAST(p_size AS VARCHAR), '0123456789', 'ABCDDCBAEb') || CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE '' END) AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(t, '[ABCD]+') THEN array_to_string(list_sort(list_distinct(string_split(t, ''))), '') END AS choice FROM r"""


def t5_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in four spellings, with known and unknown units, read back."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(n, F.lit("e2 m"))).when(k == 1, F.concat(n, F.lit("/4"))).when(k == 2, F.concat(F.lit("-"), n, F.lit(".5 kg"))).otherwise(F.concat(n, F.lit(" × 10^-3 mv")))
    read, number = G.lead_number(raw), G.as_number(raw)
    return table(spark, d, "part").select("p_partkey", F.round(read["value"], 6).alias("number"), read["tail"].alias("tail"), number["unit"].alias("unit"), G.unit_ok(read["tail"]).alias("known"))


T5 = """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 100.0 WHEN 1 THEN p_size / 4.0 WHEN 2 THEN -p_size - 0.5 ELSE p_size / 1000.0 END, 6)::DOUBLE AS number,
 CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN '' WHEN 2 THEN 'kg' ELSE 'mv' END AS tail, CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN '' WHEN 2 THEN 'kg' END AS unit, p_partkey % 4 <> 3 AS known FROM part"""


def t9_norm_expr(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit(r"$\dfrac{"), n, F.lit(r"}{2}\ \text{kg} · x^{"), F.substring(n, 1, 1), F.lit(r"} × v_{0}$"))
    return table(spark, d, "part").select("p_partkey", G.norm_expr(raw).alias("expr"))


T9 = r"SELECT p_partkey, '\frac{' || p_size || '}{2}kg\cdotx^' || left(CAST(p_size AS VARCHAR), 1) || '\timesv_0' AS expr FROM part"


def t10_blanks(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" /  / "), F.col("p_brand"), F.lit("/"))
    return table(spark, d, "part").select("p_partkey", F.array_join(G.blanks(raw), "|").alias("blanks"), G.same_value(F.col("p_retailprice"), F.col("p_retailprice") * (1 + F.when(F.col("p_partkey") % 2 == 0, 1e-7).otherwise(1e-5))).alias("same"))


T10 = "SELECT p_partkey, p_size || '|' || p_brand AS blanks, p_partkey % 2 = 0 AS same FROM part"


def t15_of_score(spark: SparkSession, d: str) -> DataFrame:
    return final_answers(answers(spark, d)).groupBy(G.verdict_of_score(F.col("score_got"), F.col("score_full")).alias("by_score"), "verdict").agg(F.count("*").alias("n"))


T15 = f"WITH {FINAL_SQL} SELECT CASE WHEN score_full <= 0 THEN NULL WHEN score_got >= score_full THEN 'right' WHEN score_got <= 0 THEN 'wrong' ELSE 'partial' END AS by_score, verdict, count(*) AS n FROM final GROUP BY 1, 2"


def t16_decide(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    got, mark = F.when(k == 1, F.col("l_tax") * 100 - 2), F.when(k == 2, "right").when(k == 3, "half").when(k == 4, "none")
    answer = F.when(F.col("l_quantity") > 30, "blank").when(F.col("l_quantity") > 10, "B").when(F.col("l_quantity") > 5, "unreadable")
    v = G.decide(got, F.lit(5.0), mark, answer)
    return table(spark, d, "lineitem").groupBy("l_linenumber", v["verdict"].alias("verdict"), v["by"].alias("by")).agg(F.count("*").alias("n"))


T16 = """SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_tax * 100 - 2 >= 5 THEN 'right' WHEN l_tax * 100 - 2 <= 0 THEN CASE WHEN l_quantity > 30 THEN 'blank' ELSE 'wrong' END ELSE 'partial' END WHEN l_linenumber = 2 THEN 'right'
 WHEN l_linenumber = 3 THEN 'partial' WHEN l_quantity > 30 THEN 'blank' ELSE 'unsure' END AS verdict, CASE WHEN l_linenumber = 1 THEN 'teacher_score' ELSE 'teacher_mark' END AS "by", count(*) AS n FROM lineitem GROUP BY 1, 2, 3"""


def t17_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Answers are letters made of line numbers; the reference is one of two, the red correction another here and there."""
    k = F.col("l_linenumber") % 4
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ABCD")), (c + 1).cast("int"))
    answer = F.when(F.col("l_quantity") < 5, "unreadable").when(F.col("l_quantity") < 8, "blank").otherwise(letter(k))
    ref = F.when(F.col("l_partkey") % 6 == 0, F.lit("")).otherwise(letter(F.col("l_partkey") % 4))
    red = F.when(F.col("l_suppkey") % 5 == 0, letter(F.col("l_suppkey") % 4))
    verdict = F.when(F.col("l_returnflag") == "R", "right").when(F.col("l_returnflag") == "A", "wrong").otherwise("partial")
    lines = table(spark, d, "lineitem").select("l_orderkey", answer.alias("answer"), verdict.alias("verdict"), red.alias("red"), ref.alias("ref"))
    inputs, found = ["answer", "verdict", "red", "ref"], F.col("found")
    checked = each_once(lines, inputs, G.crosscheck(*map(F.col, inputs)), "found")
    return checked.groupBy("l_orderkey").agg(F.count_if(found == "red").alias("n_red"), F.count_if(found == "verdict").alias("n_verdict"))


T17 = """WITH f AS (SELECT l_orderkey, CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_suppkey % 5 = 0 AND l_suppkey % 4 <> l_partkey % 4 THEN 'red'
 WHEN l_quantity >= 8 AND l_returnflag IN ('R', 'A') AND (l_linenumber % 4 = l_partkey % 4) <> (l_returnflag = 'R') THEN 'verdict' END AS f FROM lineitem)
SELECT l_orderkey, count(*) FILTER (f = 'red') AS n_red, count(*) FILTER (f = 'verdict') AS n_verdict FROM f GROUP BY 1"""

QUERIES = {
    "t3_norm_text": (t3_norm_text, T3), "t4_choice": (t4_choice, T4), "t5_numbers": (t5_numbers, T5), "t9_norm_expr": (t9_norm_expr, T9), "t10_blanks": (t10_blanks, T10), "t13_grade": (t13_grade, T13),
    "t14_answers_agree": (t14_answers_agree, T14), "t15_of_score": (t15_of_score, T15), "t16_decide": (t16_decide, T16), "t17_crosscheck": (t17_crosscheck, T17),
}
