"""Queries of updates, layouts and lookups that stand beside others of their kind, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..operators import audit, joins, layout, lookups, merge, rollup, state, windows
from ..operators import sheets as S
from ..sources.tables import ANSWERS_SQL, FINAL_SQL, LINE, PAPERS_SQL, SHEETS_SQL, answers, papers, sheets, table


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def p1_list_papers(spark: SparkSession, d: str) -> DataFrame:
    """One owner's papers, with their sheets and the latest change."""
    return lookups.list_papers(papers(spark, d).where("owner_id = 7"), {"n_sheets": sheets(spark, d)}, "paper_id", [F.max("created_at")])


P1 = f"WITH {PAPERS_SQL}, {SHEETS_SQL}, c AS (SELECT paper_id, count(*) AS n, max(created_at) AS u FROM sheets GROUP BY 1) SELECT paper_id, name, owner_id, kind, coalesce(n, 0) AS n_sheets, u AS updated_at FROM papers LEFT JOIN c USING (paper_id) WHERE owner_id = 7"


def p9_spec_fresh(spark: SparkSession, d: str) -> DataFrame:
    """P9, and T44's digest: rows whose stored digest is still that of their content; one in five was stored with another."""
    wanted = parts(spark, d).select("p_partkey", T.source_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("sha"))
    stored = parts(spark, d).select("p_partkey", T.source_hash(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type"))).alias("sha"))
    return lookups.fresh_rows(wanted, stored, ["p_partkey", "sha"])


P9 = "SELECT p_partkey, sha256(p_name || chr(1) || p_brand || chr(1) || p_type) AS sha FROM part WHERE p_partkey % 5 > 0"


def p14_sheet_answers(spark: SparkSession, d: str) -> DataFrame:
    return rollup.final_answers(answers(spark, d)).select("sheet_id", "n", "verdict", F.col("score_got").cast("double").alias("score_got"))


P14 = f"WITH {FINAL_SQL} SELECT sheet_id, n, verdict, CAST(score_got AS DOUBLE) AS score_got FROM final"


def p20_check_by(spark: SparkSession, d: str) -> DataFrame:
    """P20: answers whose provenance is none of those that there are, null included."""
    by = F.when(F.col("verdict") == "right", "code").when(F.col("verdict") == "wrong", "teacher_mark").when(F.col("n") % 2 == 0, "guess")
    return audit.invalid(answers(spark, d).select("sheet_id", "n", by.alias("by")), "by", ["teacher_score", "teacher_mark", "code", "model", "teacher"])


P20 = f"WITH {ANSWERS_SQL} SELECT sheet_id, n, CASE WHEN n % 2 = 0 THEN 'guess' END AS by FROM answers WHERE verdict = 'partial'"


def j21_locate(spark: SparkSession, d: str) -> DataFrame:
    """Offsets in a sheet's answers, each as long as its quantity; those that are open have no coordinates."""
    line = Window.partitionBy("sheet_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)).alias("n"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_linestatus") == "F").alias("ok"))
    flow = rows.withColumn("at", F.coalesce(F.sum("length").over(line), F.lit(0)))
    points = sheets(spark, d).select("sheet_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 30, 60, 500)])).alias("at"))
    return joins.locate(flow, points, ["sheet_id"], "at", "ok", ["n"])


J21 = f"""WITH r AS (SELECT l_orderkey AS sheet_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) AS n, CAST(l_quantity AS BIGINT) AS len, l_linestatus = 'F' AS ok FROM lineitem),
 f AS (SELECT *, sum(len) OVER (PARTITION BY sheet_id ORDER BY n) AS e, max(n) OVER (PARTITION BY sheet_id) AS k FROM r),
 p AS (SELECT o_orderkey AS sheet_id, CAST(unnest([0, 30, 60, 500]) AS BIGINT) AS "at" FROM orders),
 h AS (SELECT p.sheet_id, p."at", coalesce(min(f.n) FILTER (f.e > p."at"), max(f.k)) AS own FROM p LEFT JOIN f USING (sheet_id) GROUP BY 1, 2)
 SELECT h.sheet_id, h."at", coalesce(min(f.n) FILTER (f.ok AND f.n >= own), max(f.n) FILTER (f.ok AND f.n < own), max(own)) AS n FROM h LEFT JOIN f USING (sheet_id) GROUP BY 1, 2"""


def j23_place_labels(spark: SparkSession, d: str) -> DataFrame:
    """Three labels a scene, the last two at one place; a fourth that can find none."""
    label = lambda k, x, y, h: F.struct(F.lit(k).alias("label"), F.lit(ord(k)).alias("seq"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(10.0).alias("w"), F.lit(float(h)).alias("h"))
    x = F.col("p_size") % 20
    rows = parts(spark, d).select("p_partkey", F.explode(F.array(label("a", F.lit(0), 0, 5), label("b", x, 3, 5), label("c", x, 3, 5), label("d", F.lit(0), -60, 300))).alias("l")).select("p_partkey", "l.*")
    return layout.place_labels(rows, "p_partkey")


J23 = """SELECT p_partkey, k AS label, CASE k WHEN 'a' THEN 0.0 WHEN 'b' THEN CASE WHEN p_size % 20 < 10 THEN 7.0 ELSE 3.0 END WHEN 'c' THEN CASE WHEN p_size % 20 < 10 THEN 15.0 ELSE 11.0 END END::DOUBLE AS y, k <> 'd' AS placed
 FROM part, (VALUES ('a'), ('b'), ('c'), ('d')) AS v(k)"""


def a14_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A sheet's most frequent height among its full-size answers."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)).alias("n"), (F.col("l_suppkey") % 3).alias("y"), "l_linestatus")
    return layout.baseline(rows, "sheet_id", "y", "n", F.col("l_linestatus") == "F")


A14 = f"""WITH r AS (SELECT l_orderkey AS sheet_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) AS n, l_suppkey % 3 AS y, l_linestatus = 'F' AS f FROM lineitem),
 a AS (SELECT sheet_id, y, count(*) AS k, min(n) AS m, count(*) FILTER (f) AS kf, min(n) FILTER (f) AS mf FROM r GROUP BY 1, 2)
 SELECT sheet_id, coalesce(arg_max(y, kf * 1000000 - mf) FILTER (kf > 0), arg_max(y, k * 1000000 - m)) AS y FROM a GROUP BY 1"""


def a22_groups(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring parts of one main number as groups, and how many of all rows have a solution."""
    rows = parts(spark, d).select((F.col("p_partkey") % 10).alias("paper"), F.col("p_partkey").alias("at"), S.main_number(F.col("p_size") * 7).alias("main"))
    groups = windows.islands(rows, "paper", ["at"], "main").groupBy("paper").agg(F.count("*").alias("n_groups"), F.max("length").alias("longest"))
    return groups.join(lookups.filter_counts(rows, "paper", {"n_solved": F.col("main") > 2, "n_named": F.col("main") % 2 == 0}), "paper")


A22 = """WITH r AS (SELECT p_partkey % 10 AS paper, p_partkey AS a, CASE WHEN p_size * 7 >= 100 THEN p_size * 7 // 100 ELSE p_size * 7 END AS m FROM part),
 c AS (SELECT *, CASE WHEN lag(m) OVER w = m THEN 0 ELSE 1 END AS c FROM r WINDOW w AS (PARTITION BY paper ORDER BY a)),
 g AS (SELECT *, sum(c) OVER (PARTITION BY paper ORDER BY a) AS g FROM c), n AS (SELECT paper, g, count(*) AS k FROM g GROUP BY 1, 2)
 SELECT n.paper, count(*) AS n_groups, max(k) AS longest, any_value(s) AS n_solved, any_value(e) AS n_named FROM n JOIN (SELECT paper, count(*) FILTER (m > 2) AS s, count(*) FILTER (m % 2 = 0) AS e FROM r GROUP BY 1) q USING (paper) GROUP BY 1"""


def w7_option_figures(spark: SparkSession, d: str) -> DataFrame:
    """A figure of the stem, and four below it whose columns align in every other question."""
    shift = F.when(F.col("p_size") % 2 == 0, 0).otherwise(10)
    box = lambda i, x, top: F.struct(F.lit(i).alias("figure"), F.lit(1).alias("page"), x.cast("double").alias("x"), F.lit(float(top)).alias("top"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    boxes = F.array(box(0, F.lit(5), 200), box(1, F.lit(0), 100), box(2, F.lit(20), 100), box(3, shift, 85), box(4, shift + 20, 85))
    return layout.option_figures(parts(spark, d).select("p_partkey", F.explode(boxes).alias("b")).select("p_partkey", "b.*"), "p_partkey", 4)


W7 = "SELECT p_partkey, f AS figure, f > 0 AND p_size % 2 = 0 AS is_option FROM part, (VALUES (0), (1), (2), (3), (4)) AS v(f)"


def k3_page_order(spark: SparkSession, d: str) -> DataFrame:
    """K3: uploaded pages in the order of the numbers in their names, whatever the folder and the case."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "a/PAGE").otherwise("b/page"), F.col("p_partkey").cast("string"), F.lit(".PNG"))
    rows = parts(spark, d).select("p_brand", "p_partkey", windows.natural_key(name).alias("_key"))
    return rows.withColumn("page", F.row_number().over(Window.partitionBy("p_brand").orderBy("_key"))).drop("_key")


K3 = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page FROM part"


def k4_reading_order(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).select("p_brand", "p_partkey", (F.col("p_partkey") % 4).alias("page"), F.col("p_size").alias("y"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(*windows.reading("page", "y"), "p_partkey")))


K4 = "SELECT p_brand, p_partkey, p_partkey % 4 AS page, p_size AS y, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 4, p_size DESC, p_partkey) AS k FROM part"


def m1_upsert(spark: SparkSession, d: str) -> DataFrame:
    """M1: half of the papers come again under another owner; who has an owner keeps it, and new papers take theirs."""
    every = papers(spark, d).select("paper_id", "name", "owner_id")
    old = every.where("paper_id % 3 > 0").withColumn("owner_id", F.when(F.col("paper_id") % 7 > 0, F.col("owner_id")))
    return merge.upsert(old, every.where("paper_id % 2 = 0").select("paper_id", F.concat("name", F.lit("!")).alias("name"), F.lit(99).alias("owner_id")), "paper_id", ["name"], ["owner_id"])


M1 = f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN name || '!' ELSE name END AS name, CAST(CASE WHEN paper_id % 3 > 0 AND paper_id % 7 > 0 THEN owner_id WHEN paper_id % 2 = 0 THEN 99 END AS INT) AS owner_id FROM papers WHERE paper_id % 3 > 0 OR paper_id % 2 = 0"


def m6_put_answer(spark: SparkSession, d: str) -> DataFrame:
    """M6: some fields of some answers are given anew, and the sheets of those answers change."""
    key = F.concat_ws("-", "sheet_id", "n").alias("answer")
    old = answers(spark, d).select(key, "sheet_id", "verdict", F.col("score_got").cast("double").alias("score_got"))
    given = answers(spark, d).where("part_id % 4 = 0").select(key, F.when(F.col("part_id") % 8 == 0, "blank").alias("verdict"), F.lit(1.0).alias("score_got"))
    now = old.select("answer", "sheet_id").join(merge.partial_update(old, given, "answer", ["verdict", "score_got"]), "answer")
    return now.groupBy("sheet_id").agg(F.count_if("touched").alias("n_touched"), F.count_if(F.col("verdict") == "blank").alias("n_blank"), F.bool_or("touched").alias("changed"))


M6 = f"WITH {ANSWERS_SQL} SELECT sheet_id, count(*) FILTER (part_id % 4 = 0) AS n_touched, count(*) FILTER (part_id % 8 = 0) AS n_blank, bool_or(part_id % 4 = 0) AS changed FROM answers GROUP BY 1"


def m9_put_failure(spark: SparkSession, d: str) -> DataFrame:
    """M9: failures replace solutions and older failures."""
    rows = parts(spark, d).select("p_partkey", F.repeat("p_name", 30).alias("reason"))
    solved, failed = merge.put_failures(rows.where("p_partkey % 2 = 0").select("p_partkey"), rows.where("p_partkey % 2 = 1").withColumn("reason", F.lit("old")), rows.where("p_partkey % 3 = 0"), "p_partkey", "reason")
    return failed.withColumn("kind", F.lit("failure")).unionByName(solved.select("p_partkey", F.lit(None).cast("string").alias("reason"), F.lit("solution").alias("kind")))


M9 = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN left(repeat(p_name, 30), 240) WHEN p_partkey % 2 = 1 THEN 'old' END AS reason, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 1 THEN 'failure' ELSE 'solution' END AS kind FROM part"


def m10_clear_failure(spark: SparkSession, d: str) -> DataFrame:
    """The brands whose failures were cleared, with the failures that each of them still has."""
    failures = parts(spark, d).where("p_size % 2 = 0").select("p_partkey", "p_brand")
    stay, bumped = merge.clear_failures(failures, parts(spark, d).where("p_size % 10 = 0"), "p_partkey", "p_brand")
    return lookups.child_count(bumped, stay, "p_brand")


M10 = "SELECT p_brand, count(*) FILTER (p_size % 10 > 0) AS n_children FROM part WHERE p_size % 2 = 0 GROUP BY 1 HAVING bool_or(p_size % 10 = 0)"


def m17_put_stem(spark: SparkSession, d: str) -> DataFrame:
    """Stems for questions, one in five of which is not there."""
    new = parts(spark, d).select("p_partkey", F.upper("p_name").alias("stem"))
    return merge.update_or_report(parts(spark, d).where("p_partkey % 5 > 0"), new, "p_partkey", "stem")


M17 = "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN upper(p_name) END AS stem, CASE WHEN p_partkey % 5 > 0 THEN 'updated' ELSE 'missing' END AS action FROM part"


def m19_put_worth(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question is worth a scene and why, where that has been judged."""
    old = parts(spark, d).select("p_partkey", F.lit(None).cast("boolean").alias("worth"), F.lit("").alias("why"))
    return merge.partial_update(old, parts(spark, d).where("p_size > 20").select("p_partkey", (F.col("p_size") > 30).alias("worth"), F.col("p_type").alias("why")), "p_partkey", ["worth", "why"])


M19 = "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size > 30 END AS worth, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS why, p_size > 20 AS touched FROM part"


def m20_approve_spec(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).select("p_partkey", F.lit("draft").alias("status"))
    return merge.approve(rows, parts(spark, d).where("p_partkey % 3 > 0").select("p_partkey", (F.col("p_partkey") % 3 == 1).alias("ok")), "p_partkey", "ok", "status")


M20 = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status FROM part"


def m28_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with a score by a teacher has been scored as a whole."""
    return merge.any_sibling(answers(spark, d), "sheet_id", F.col("teacher_score_got").isNotNull()).select("sheet_id", "n", "judged")


M28 = f"WITH {ANSWERS_SQL} SELECT sheet_id, n, bool_or(teacher_score_got IS NOT NULL) OVER (PARTITION BY sheet_id) AS judged FROM answers"


def m31_merge_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The second table of each document goes on from the first; some are empty, others have rows of another width."""
    own = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<int>")).when(F.col("p_size") % 3 == 1, F.array(F.lit(4), F.lit(4))).otherwise(F.array(F.lit(4), F.lit(3)))
    pair = F.array(F.struct(F.lit(1).alias("tid"), F.lit(None).cast("int").alias("parent"), F.array(F.lit(4)).alias("widths")), F.struct(F.lit(2).alias("tid"), F.lit(1).alias("parent"), own.alias("widths")))
    return merge.merge_warnings(parts(spark, d).select("p_partkey", F.explode(pair).alias("t")).select("p_partkey", "t.*"), "p_partkey", "tid", "parent", "widths")


M31 = "SELECT p_partkey, 2 AS tid, 1 AS parent, CASE p_size % 3 WHEN 0 THEN 'empty' ELSE 'width' END AS why FROM part WHERE p_size % 3 <> 1"


def t11_same_value(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that differ by a little, and texts with and without letters."""
    x = F.col("p_size").cast("double")
    return parts(spark, d).select("p_partkey", G.same_value(x, x * (1 + 1e-7)).alias("near"), G.same_value(x, x * (1 + 1e-5)).alias("far"), G.wordy(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("力 12")).alias("wordy"))


T11 = "SELECT p_partkey, true AS near, p_size = 0 AS far, p_partkey % 2 = 1 AS wordy FROM part"


def t31_radical_lines(spark: SparkSession, d: str) -> DataFrame:
    """A sign with three rules near it, one below it and one whose beginning moves away."""
    signs = parts(spark, d).select("p_partkey", F.lit(1).alias("sign"), F.lit(10.0).alias("x1"), F.lit(50.0).alias("y"))
    rule = lambda i, x, y: F.struct(F.lit(i).alias("rule"), x.cast("double").alias("x0"), F.lit(y).alias("y"))
    rules = parts(spark, d).select("p_partkey", F.explode(F.array(rule(1, F.col("p_size") % 5 + 10, 60.0), rule(2, F.lit(10), 55.0), rule(3, F.lit(10), 40.0))).alias("r")).select("p_partkey", "r.*")
    return layout.radical_lines(signs, rules, "p_partkey")


T31 = "SELECT p_partkey, 1 AS sign, CASE WHEN p_size % 5 <= 3 THEN 1 ELSE 2 END AS rule FROM part"


def t38_loads_json(spark: SparkSession, d: str) -> DataFrame:
    """A reply with words around its object and a formula whose backslash is no escape."""
    reply = F.concat(F.lit('Here:\n{"tex": "\\alpha '), F.col("p_name"), F.lit('",\n "n": '), F.col("p_size").cast("string"), F.lit("}\nDone."))
    return parts(spark, d).select("p_partkey", T.first_object(reply, "tex string, n int").alias("o")).select("p_partkey", "o.tex", "o.n")


T38 = r"SELECT p_partkey, '\alpha ' || p_name AS tex, p_size AS n FROM part"


def t67_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What is sent on of a stem and a solution, each cut to its length."""
    stem, solved = F.repeat("p_name", 20), F.repeat("p_type", 40)
    short = T.payload([(stem, 220), (solved, 260)])
    return parts(spark, d).select("p_partkey", short.alias("outline"), T.payload([(stem, 300), (F.lit(None).cast("string"), 200), (solved, 260)]).alias("pick"), T.payload([(solved, 600)]).alias("advice"))


T67 = "SELECT p_partkey, left(repeat(p_name, 20), 220) || chr(10) || left(repeat(p_type, 40), 260) AS outline, left(repeat(p_name, 20), 300) || chr(10) || left(repeat(p_type, 40), 260) AS pick, left(repeat(p_type, 40), 600) AS advice FROM part"


def t71_show_number(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", T.show_number(F.col("p_partkey")).alias("shown"))


T71 = "SELECT p_partkey, CASE WHEN p_partkey >= 100 THEN (p_partkey // 100) || '(' || (p_partkey % 100) || ')' ELSE CAST(p_partkey AS VARCHAR) END AS shown FROM part"


def st5_timing(spark: SparkSession, d: str) -> DataFrame:
    """ST5: how long papers have been idle and how long they took, at a given time; some have been put together."""
    ago = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) - seconds)
    assembled = F.when(F.col("p_partkey") % 2 == 0, ago(F.col("p_size") * 5))
    t = state.timing(ago(F.col("p_size") * 10), F.when(F.col("p_partkey") % 3 > 0, ago(F.col("p_size") * 100)), assembled, ago(F.lit(0)))
    return parts(spark, d).select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


ST5 = "SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS idle, p_size * 10 < 180 AS busy, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_size * 100 - CASE WHEN p_partkey % 2 = 0 THEN p_size * 5 ELSE 0 END END AS BIGINT) AS elapsed FROM part"


def st9_failed_job(spark: SparkSession, d: str) -> DataFrame:
    """ST9: papers whose very last job failed."""
    return state.last_job(sheets(spark, d), "paper_id", "sheet_id", "status", ["O"], ["F"]).where("failed").select("paper_id")


ST9 = f"WITH {SHEETS_SQL} SELECT paper_id FROM sheets GROUP BY 1 HAVING arg_max(status, sheet_id) = 'F'"

QUERIES = {
    "p1_list_papers": (p1_list_papers, P1), "p9_spec_fresh": (p9_spec_fresh, P9), "p14_sheet_answers": (p14_sheet_answers, P14), "p20_check_by": (p20_check_by, P20), "j21_locate": (j21_locate, J21), "j23_place_labels": (j23_place_labels, J23),
    "a14_baseline": (a14_baseline, A14), "a22_groups": (a22_groups, A22), "w7_option_figures": (w7_option_figures, W7), "k3_page_order": (k3_page_order, K3), "k4_reading_order": (k4_reading_order, K4), "m1_upsert": (m1_upsert, M1), "m6_put_answer": (m6_put_answer, M6),
    "m9_put_failure": (m9_put_failure, M9), "m10_clear_failure": (m10_clear_failure, M10), "m17_put_stem": (m17_put_stem, M17), "m19_put_worth": (m19_put_worth, M19), "m20_approve_spec": (m20_approve_spec, M20), "m28_backfill": (m28_backfill, M28), "m31_merge_warnings": (m31_merge_warnings, M31),
    "t11_same_value": (t11_same_value, T11), "t31_radical_lines": (t31_radical_lines, T31), "t38_loads_json": (t38_loads_json, T38), "t67_payloads": (t67_payloads, T67), "t71_show_number": (t71_show_number, T71), "st5_timing": (st5_timing, ST5), "st9_failed_job": (st9_failed_job, ST9),
}
