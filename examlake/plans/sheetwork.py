"""Queries of answer sheets and of the stages of papers over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sheets
from ..sources.tables import ANSWERS_SQL, PAPERS_SQL, SHEETS_SQL, answers, papers, table
from ..sources.tables import sheets as sheet_rows


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Numbers as read, whole ones and parts, and those of the reference, of each order."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sheet_id")
    number = lambda whole: F.when(whole, F.col("l_linenumber").cast("long")).otherwise(F.col("l_linenumber") * 100 + F.col("l_partkey") % 3 + 1).cast("long").alias("n")
    return lines.select("sheet_id", number(F.col("l_returnflag") == "N")).distinct(), lines.where("sheet_id % 11 <> 0 AND l_partkey % 5 <> 0").select("sheet_id", number(F.col("l_suppkey") % 3 == 0)).distinct()


def j10_bind(spark: SparkSession, d: str) -> DataFrame:
    return sheets.bind(*_numbered(spark, d), "sheet_id", "n").select("sheet_id", "n", "bind", "bind_main", "kind")


J10 = """WITH h AS (SELECT DISTINCT l_orderkey AS sheet_id, CAST(l_linenumber AS BIGINT) AS m, CAST(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE l_linenumber * 100 + l_partkey % 3 + 1 END AS BIGINT) AS n FROM lineitem),
w AS (SELECT DISTINCT l_orderkey AS sheet_id, CAST(l_linenumber AS BIGINT) AS m, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE l_linenumber * 100 + l_partkey % 3 + 1 END AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_partkey % 5 <> 0),
gh AS (SELECT sheet_id, m, list_sort(list(n)) AS have FROM h GROUP BY 1, 2), gw AS (SELECT sheet_id, m, list_sort(list(n)) AS want FROM w GROUP BY 1, 2),
k AS (SELECT sheet_id, m, CASE WHEN want IS NULL THEN 'unknown' WHEN have = want THEN 'bound' WHEN have = [m] THEN 'whole' WHEN list_has_all(want, have) THEN 'missing' ELSE 'mismatch' END AS kind FROM gh LEFT JOIN gw USING (sheet_id, m))
SELECT sheet_id, n, CASE WHEN kind IN ('bound', 'missing') THEN n END AS bind, CASE WHEN kind = 'whole' THEN m END AS bind_main, kind FROM h JOIN k USING (sheet_id, m)"""


def j10_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What a page says about each whole question that isn't bound: its kind, and how many numbers it lacks."""
    kinds = sheets.bind_kinds(*_numbered(spark, d), "sheet_id", "n").where("kind <> 'bound'")
    return kinds.select("sheet_id", "main", "kind", F.size("have").alias("n_have"), F.when(F.col("want").isNotNull(), F.size(F.array_except("want", "have"))).alias("n_lacking"))


J10W = J10[: J10.index("k AS (")] + (
    "k AS (SELECT sheet_id, m AS main, CASE WHEN want IS NULL THEN 'unknown' WHEN have = want THEN 'bound' WHEN have = [m] THEN 'whole' WHEN list_has_all(want, have) THEN 'missing' ELSE 'mismatch' END AS kind, CAST(len(have) AS INT) AS n_have, CAST(len(list_filter(want, lambda x: NOT list_contains(have, x))) AS INT) AS n_lacking FROM gh LEFT JOIN gw USING (sheet_id, m)) SELECT * FROM k WHERE kind <> 'bound'"
)


def _stems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n"), "p_name")
    return p.where("n % 3 = 0 OR n < 15"), p.where("n % 4 <> 1").select("n")


def j11_spread(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are part keys; stems of numbers that the reference lacks go to its parts of them."""
    return sheets.spread(*_stems(spark, d), "p_name")


J11 = """WITH v AS (SELECT p_partkey AS n, p_name FROM part WHERE p_partkey % 3 = 0 OR p_partkey < 15), k AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 4 <> 1)
SELECT k.n, coalesce(o.p_name, w.p_name) AS p_name FROM k LEFT JOIN v o ON o.n = k.n LEFT JOIN v w ON k.n >= 100 AND w.n = k.n // 100 AND w.n % 4 = 1 WHERE o.n IS NOT NULL OR w.n IS NOT NULL"""


def j11_extras(spark: SparkSession, d: str) -> DataFrame:
    return sheets.spread_extras(*_stems(spark, d))


J11X = """WITH v AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 3 = 0 OR p_partkey < 15), k AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 4 <> 1)
SELECT n FROM v WHERE n NOT IN (SELECT n FROM k) AND n NOT IN (SELECT n // 100 FROM k WHERE n >= 100)"""


def j12_merge(spark: SparkSession, d: str) -> DataFrame:
    def reading(status: str) -> DataFrame:
        per = table(spark, d, "lineitem").where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("f"), F.max("l_quantity").alias("got"), F.max("l_partkey").alias("p"))
        return per.select("sheet_id", "n", F.when(F.col("p") % 5 == 0, "unknown").otherwise(F.col("f")).alias("mark"), F.when(F.col("p") % 7 == 0, "unreadable").when(F.col("p") % 7 == 1, "blank").otherwise(F.col("f")).alias("answer"), F.when(F.col("p") % 3 > 0, F.col("got")).alias("got"))

    return sheets.merge_reads(reading("O"), reading("F"), ["sheet_id", "n"], ["mark", "answer", "got"])


_READ = "SELECT l_orderkey AS sheet_id, l_linenumber AS n, CASE WHEN max(l_partkey) % 5 = 0 THEN 'unknown' ELSE max(l_returnflag) END AS mark, CASE max(l_partkey) % 7 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'blank' ELSE max(l_returnflag) END AS answer, CASE WHEN max(l_partkey) % 3 > 0 THEN max(l_quantity) END AS got FROM lineitem WHERE l_linestatus = '{}' GROUP BY 1, 2"
J12 = f"""WITH a AS ({_READ.format("O")}), b AS ({_READ.format("F")}),
j AS (SELECT sheet_id, n, a.sheet_id IS NULL AS only_second, a.mark AS m1, b.mark AS m2, nullif(a.mark, 'unknown') AS x1, nullif(b.mark, 'unknown') AS x2, a.answer AS s1, b.answer AS s2, CASE WHEN a.answer NOT IN ('blank', 'unreadable') THEN a.answer END AS y1, CASE WHEN b.answer NOT IN ('blank', 'unreadable') THEN b.answer END AS y2, a.got AS g1, b.got AS g2 FROM a FULL JOIN b USING (sheet_id, n))
SELECT sheet_id, n, coalesce(x1, x2, m1, m2) AS mark, coalesce(y1, y2, s1, s2) AS answer, coalesce(g1, g2) AS got, concat_ws(',', CASE WHEN x1 <> x2 THEN 'mark' END, CASE WHEN y1 <> y2 THEN 'answer' END, CASE WHEN g1 <> g2 THEN 'got' END) AS conflicts, only_second FROM j"""


def a8_checksum(spark: SparkSession, d: str) -> DataFrame:
    """A third of the sheets have no total, and a fifth of the answers no points."""
    rows = answers(spark, d).withColumn("score_got", F.when(F.col("part_id") % 5 > 0, F.col("score_got")))
    return sheets.checksum(rows, sheet_rows(spark, d).withColumn("total", F.when(F.col("sheet_id") % 3 > 0, F.col("total"))), "sheet_id")


A8 = f"""WITH {SHEETS_SQL}, {ANSWERS_SQL}, g AS (SELECT sheet_id, coalesce(sum(score_got) FILTER (part_id % 5 > 0), 0) AS got, count(*) FILTER (part_id % 5 = 0) AS unscored FROM answers GROUP BY 1),
t AS (SELECT sheet_id, coalesce(got, 0) AS got, CASE WHEN sheet_id % 3 > 0 THEN total END AS total, coalesce(unscored, 0) AS unscored FROM sheets LEFT JOIN g USING (sheet_id))
SELECT sheet_id, CAST(got AS DOUBLE) AS got, CAST(total AS DOUBLE) AS total, CASE WHEN total IS NULL THEN 'no total' WHEN abs(got - total) < 0.01 THEN 'ok' ELSE 'off' END AS state, unscored FROM t"""


def m11_teacher(spark: SparkSession, d: str) -> DataFrame:
    """Right and wrong with and without a score of their own, partial with one, and verdicts taken back."""
    verdict = F.when(F.col("n") == 1, "right").when(F.col("n") == 2, "wrong").when(F.col("n") == 3, "partial")
    given = F.when((F.col("n") == 3) | (F.col("part_id") % 4 == 0), F.col("score_got"))
    return sheets.teacher_override(answers(spark, d), verdict, given).select("sheet_id", "n", "teacher_verdict", F.col("teacher_score_got").cast("double").alias("score"))


M11 = f"WITH {ANSWERS_SQL} SELECT sheet_id, CAST(n AS INT) AS n, CASE n WHEN 1 THEN 'right' WHEN 2 THEN 'wrong' WHEN 3 THEN 'partial' END AS teacher_verdict, CAST(CASE WHEN n > 3 THEN NULL WHEN n = 3 OR part_id % 4 = 0 THEN score_got WHEN n = 1 THEN score_full WHEN n = 2 THEN 0 END AS DOUBLE) AS score FROM answers"


def m23_first_answer(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of each conversation, without turns that say nothing, and without numbers for the second of them."""
    n = F.when(F.col("turn") % 5 < 4, F.col("turn") % 2)
    rows = table(spark, d, "conversations").select("conv_id", n.alias("n"), F.concat(F.col("turn").cast("string"), F.lit(" "), F.col("role")).alias("at"), F.when(F.col("turn") % 3 > 0, F.col("role")).otherwise(F.lit(" ")).alias("answer"), F.when(F.length("text") % 4 > 0, F.md5("text")).alias("solution"))
    return sheets.first_answer_all_solutions(rows, ["conv_id", "n"], "at", "answer", "solution")


M23 = """WITH r AS (SELECT conv_id, CASE WHEN turn % 5 < 4 THEN turn % 2 END AS n, turn || ' ' || role AS a, CASE WHEN turn % 3 > 0 THEN role ELSE '' END AS answer, CASE WHEN length(text) % 4 > 0 THEN md5(text) END AS s FROM conversations)
SELECT conv_id, n, arg_min(answer, (a, answer, s)) AS answer, string_agg(s, ' ' ORDER BY a, answer, s) AS solution FROM r WHERE n IS NOT NULL AND answer <> '' GROUP BY 1, 2"""

#: what a lineitem counts as in the progress of a paper
_COUNTS = {
    "questions": "true", "solutions": "l_returnflag <> 'A'", "failures": "l_returnflag = 'A' AND l_linestatus = 'F'", "labels": "l_returnflag <> 'A' AND l_quantity > 2", "kps": "l_quantity > 3 OR l_tax > 0.01", "judged": "l_returnflag <> 'A' AND l_quantity > 4",
    "worth": "l_quantity > 30", "specs_worth": "l_quantity > 30 AND l_tax > 0", "specs": "l_quantity > 25", "drafts": "l_returnflag = 'N' AND l_quantity > 47", "ready": "l_quantity > 28", "scene_tried": "l_quantity > 28 AND l_discount > 0.005",
}


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """The counts of each order with lines; points are judged, not just there, in two of three orders."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id")).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTS.items()])
    return lines.withColumn("kps_judged", F.when(F.col("sheet_id") % 3 > 0, F.col("questions"))).withColumn("assembled_fresh", F.col("sheet_id") % 4 > 0)


_PROGRESS = "g AS (SELECT l_orderkey AS sheet_id, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTS.items()) + " FROM lineitem GROUP BY 1), pg AS (SELECT *, CASE WHEN sheet_id % 3 > 0 THEN questions END AS kps_judged, sheet_id % 4 > 0 AS assembled_fresh FROM g)"


def f1_stage(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d).select("sheet_id", sheets.paper_stage().alias("s")).select("sheet_id", "s.stage", "s.done", "s.total")


_STAGES = [("solve", "solutions + failures < questions", "solutions + failures", "questions"), ("outline", "labels < solutions", "labels", "solutions"), ("kpmark", "coalesce(kps_judged, kps) < questions", "coalesce(kps_judged, kps)", "questions"), ("pick", "judged < solutions", "judged", "solutions"), ("spec", "specs_worth < worth", "specs_worth", "worth"), ("check", "drafts > 0", "specs - drafts", "specs"), ("scene", "scene_tried < ready", "scene_tried", "ready"), ("assemble", "NOT assembled_fresh", "0", "1")]
_CASE = [" ".join(f"WHEN {c} THEN " + (f"'{s}'" if k == 0 else (a, b)[k - 1]) for s, c, a, b in _STAGES) for k in range(3)]
F1 = f"WITH {_PROGRESS} SELECT sheet_id, CASE {_CASE[0]} ELSE 'done' END AS stage, CAST(CASE {_CASE[1]} ELSE 1 END AS BIGINT) AS done, CAST(CASE {_CASE[2]} ELSE 1 END AS BIGINT) AS total FROM pg"


def f2_sheet_stage(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines have no reference answers yet."""
    rows = sheet_rows(spark, d).select("sheet_id").join(_progress(spark, d), "sheet_id", "left").withColumn("questions", F.when(F.col("sheet_id") % 5 > 0, F.coalesce("questions", F.lit(0))).otherwise(0))
    return rows.select("sheet_id", sheets.sheet_stage().alias("s")).select("sheet_id", "s.stage", "s.done", "s.total")


F2 = f"""WITH {_PROGRESS}, q AS (SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 5 > 0 THEN coalesce(questions, 0) ELSE 0 END AS questions, coalesce(kps_judged, kps, 0) AS k FROM orders LEFT JOIN pg ON sheet_id = o_orderkey)
SELECT sheet_id, CASE WHEN questions = 0 THEN 'refread' WHEN k < questions THEN 'kpmark' ELSE 'done' END AS stage, CAST(CASE WHEN questions = 0 THEN 0 WHEN k < questions THEN k ELSE 1 END AS BIGINT) AS done, CAST(CASE WHEN questions = 0 THEN 1 WHEN k < questions THEN questions ELSE 1 END AS BIGINT) AS total FROM q"""


def f3_mode_of(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "BUILDING", "answers_only").when(F.col("kind") == "MACHINERY", F.lit(None)).otherwise("pdf")
    return papers(spark, d).select("paper_id", sheets.mode_of(kind).alias("mode"))


F3 = f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN kind = 'BUILDING' THEN 'sheet' ELSE 'paper' END AS mode FROM papers"


def f6_papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders are papers here; a third of them have answers alone."""
    rows = sheet_rows(spark, d).select("sheet_id", F.when(F.col("sheet_id") % 3 == 0, "answers_only").otherwise("pdf").alias("source_kind"), "created_at")
    return sheets.papers_with_stage(rows, _progress(spark, d), "sheet_id", "source_kind")


F6 = f"""WITH {_PROGRESS}, s AS (SELECT sheet_id, CASE {_CASE[0]} ELSE 'done' END AS a, CASE {_CASE[1]} ELSE 1 END AS b, CASE {_CASE[2]} ELSE 1 END AS c,
 CASE WHEN coalesce(kps_judged, kps) < questions THEN 'kpmark' ELSE 'done' END AS x, CASE WHEN coalesce(kps_judged, kps) < questions THEN coalesce(kps_judged, kps) ELSE 1 END AS y, CASE WHEN coalesce(kps_judged, kps) < questions THEN questions ELSE 1 END AS z FROM pg),
j AS (SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 3 = 0 THEN 'answers_only' ELSE 'pdf' END AS source_kind, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'sheet' ELSE 'paper' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN x ELSE a END AS stage, CAST(CASE WHEN o_orderkey % 3 = 0 THEN y ELSE b END AS BIGINT) AS done, CAST(CASE WHEN o_orderkey % 3 = 0 THEN z ELSE c END AS BIGINT) AS total FROM orders LEFT JOIN s ON sheet_id = o_orderkey)
SELECT *, stage = 'done' AS finished FROM j"""


def f6_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The papers of one mode."""
    rows = sheet_rows(spark, d).select("sheet_id", F.when(F.col("sheet_id") % 3 == 0, "answers_only").otherwise("pdf").alias("source_kind"), "created_at")
    return sheets.papers_with_stage(rows, _progress(spark, d), "sheet_id", "source_kind", "sheet")


F6S = F6 + " WHERE mode = 'sheet'"


def f4_cells(spark: SparkSession, d: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("solve", "outline", "kpmark", "pick", "spec", "check", "scene", "assemble")))
    stage = F.when(F.col("s_suppkey") % 9 > 0, F.element_at(stages, (F.col("s_suppkey") % 9).cast("int")))
    failed = F.when(F.col("s_acctbal") < 0, F.when(F.col("s_suppkey") % 2 == 0, "ingest").otherwise("scene"))
    have = F.array_compact(F.array(F.when(F.col("s_suppkey") % 3 == 0, "scene"), F.when(F.col("s_suppkey") % 4 == 0, "assemble")))
    return sheets.cell_states(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "paper", stage, F.col("s_suppkey") % 7 == 0, failed, have).select("s_suppkey", "position", "cell", "state")


F4 = """WITH c AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['ingest', 'segment', 'solve', 'spec', 'scene', 'assemble']) AS cell, unnest([false, false, false, false, true, true]) AS need),
s AS (SELECT s_suppkey, pos, cell, need, s_suppkey % 7 = 0 AS done, CASE WHEN s_suppkey % 7 > 0 THEN [NULL, 2, 2, 2, 3, 3, 3, 4, 5][s_suppkey % 9 + 1] END AS cur, CASE WHEN s_acctbal < 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 4 END END AS bad, (cell = 'scene' AND s_suppkey % 3 = 0) OR (cell = 'assemble' AND s_suppkey % 4 = 0) AS have FROM supplier, c),
t AS (SELECT *, CASE WHEN bad IS NOT DISTINCT FROM pos THEN 'fail' WHEN done THEN 'done' WHEN cur IS NULL THEN CASE WHEN have THEN 'done' ELSE 'todo' END WHEN pos < cur THEN 'done' WHEN pos > cur THEN 'todo' ELSE 'now' END AS st FROM s)
SELECT s_suppkey, pos AS position, cell, CASE WHEN need AND st NOT IN ('now', 'fail') THEN CASE WHEN have THEN 'done' WHEN st = 'done' THEN 'empty' ELSE st END ELSE st END AS state FROM t"""


def f8_sheet_state(spark: SparkSession, d: str) -> DataFrame:
    n = answers(spark, d).groupBy("sheet_id").agg(F.count("*").alias("n"))
    s = sheet_rows(spark, d).join(n, "sheet_id", "left").withColumn("n", F.when(F.col("sheet_id") % 9 > 0, F.coalesce("n", F.lit(0))).otherwise(0))
    status = F.when(F.col("status") == "O", "running").when(F.col("status") == "P", "error").when(F.col("sheet_id") % 2 == 0, "done")
    state = sheets.sheet_state(status, F.when(F.col("sheet_id") % 13 == 0, F.lit("note")), F.when(F.col("sheet_id") % 4 > 0, F.col("sheet_id") % 1200), F.col("n"))
    return s.select("sheet_id", state.alias("s")).select("sheet_id", "s.state", "s.note", "s.run_seconds")


F8 = """SELECT o_orderkey AS sheet_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 9 > 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'done' ELSE 'empty' END END AS state,
 CASE WHEN o_orderkey % 13 = 0 THEN 'note' END AS note, CASE WHEN o_orderstatus = 'O' THEN CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1200 ELSE 0 END AS BIGINT) END AS run_seconds FROM orders"""


def f12_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order are calls; those with a returned flag failed, those of large quantity conflict."""
    call = F.struct(F.col("n").alias("page"), F.when(F.col("n") % 2 == 0, "b").otherwise("a").alias("pass"), (F.col("verdict") != "wrong").alias("ok"))
    clash = F.when(F.col("part_id") % 2 == 0, F.concat(F.lit("no. "), F.col("n").cast("string")))
    per = answers(spark, d).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("n", call.alias("c"), clash.alias("k")))).alias("x"))
    calls, clashes = F.transform("x", lambda x: x["c"]), F.array_compact(F.transform("x", lambda x: x["k"]))
    ok = F.col("sheet_id") % 2 == 0
    lines = sheets.sheet_report(F.size("x"), calls, F.when(F.col("sheet_id") % 10 == 0, "given up"), clashes, ok, F.when(ok, "sums agree").otherwise("sums differ"), most=2)
    return per.select("sheet_id", F.array_join(lines, "\n").alias("report"))


F12 = f"""WITH {ANSWERS_SQL}, g AS (SELECT sheet_id, count(*) AS n, count(*) FILTER (verdict = 'wrong') AS bad, string_agg('page ' || n || CASE WHEN n % 2 = 0 THEN ' b' ELSE ' a' END, ', ' ORDER BY n) FILTER (verdict = 'wrong') AS calls, coalesce(list('  ! no. ' || n ORDER BY n) FILTER (part_id % 2 = 0), []) AS k FROM answers GROUP BY 1)
SELECT sheet_id, concat_ws(chr(10), 'reading: ' || n || ' pages, ' || n || ' calls', CASE WHEN bad > 0 THEN '  ! ' || bad || ' calls failed: ' || calls END, CASE WHEN sheet_id % 10 = 0 THEN '  x given up' END, k[1], k[2], CASE WHEN len(k) > 2 THEN '  ! ' || (len(k) - 2) || ' more conflicts' END, CASE WHEN sheet_id % 2 = 0 THEN '  ok sums agree' ELSE '  ! sums differ' END) AS report FROM g"""


def p15_plan(spark: SparkSession, d: str) -> DataFrame:
    n = answers(spark, d).groupBy("sheet_id").agg(F.count("*").alias("n"), F.max("score_full").alias("best"))
    s = sheet_rows(spark, d).join(n, "sheet_id", "left")
    status = F.when(F.col("status") == "F", "approved").when(F.col("status") == "P", "draft")
    worth = F.when(F.col("sheet_id") % 5 > 0, F.col("best") >= 30000)
    has = F.col("n").isNotNull() & (F.col("sheet_id") % 6 > 0)
    reasons = [sheets.plan_reason(only, F.col("sheet_id") % 17 == 0, has, F.col("n") > 1, status, worth, **flags).alias(name) for name, only, flags in (("why", F.lit(None).cast("boolean"), {}), ("why_asked", F.col("sheet_id") % 4 < 2, {}), ("why_all", F.lit(None).cast("boolean"), {"allow_draft": True, "do_all": True, "redo": True}))]
    return s.select("sheet_id", *reasons)


P15 = f"""WITH {SHEETS_SQL}, g AS (SELECT l_orderkey AS sheet_id, count(*) AS n, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS best FROM lineitem GROUP BY 1),
s AS (SELECT sheet_id, n IS NOT NULL AND sheet_id % 6 > 0 AS has, n > 1 AS animatable, status, sheet_id % 5 > 0 AS judged, best >= 30000 AS worth FROM sheets LEFT JOIN g USING (sheet_id)),
r AS (SELECT *, CASE WHEN NOT has THEN 'no spec' WHEN NOT animatable THEN 'not animatable' END AS early, CASE WHEN status <> 'F' THEN 'not approved' WHEN judged AND NOT worth THEN 'not worth it' END AS late FROM s)
SELECT sheet_id, CASE WHEN sheet_id % 17 = 0 THEN 'done' ELSE coalesce(early, late, CASE WHEN NOT judged THEN 'unjudged' END) END AS why, CASE WHEN sheet_id % 4 >= 2 THEN 'not asked for' ELSE coalesce(early, late) END AS why_asked, early AS why_all FROM r"""

QUERIES = {
    "j10_bind": (j10_bind, J10), "j10_warnings": (j10_warnings, J10W), "j11_spread": (j11_spread, J11), "j11_extras": (j11_extras, J11X), "j12_merge": (j12_merge, J12), "a8_checksum": (a8_checksum, A8), "m11_teacher": (m11_teacher, M11), "m23_first_answer": (m23_first_answer, M23),
    "f1_stage": (f1_stage, F1), "f2_sheet_stage": (f2_sheet_stage, F2), "f3_mode_of": (f3_mode_of, F3), "f4_cells": (f4_cells, F4), "f6_papers": (f6_papers, F6), "f6_sheets": (f6_sheets, F6S), "f8_sheet_state": (f8_sheet_state, F8), "f12_report": (f12_report, F12), "p15_plan": (p15_plan, P15),
}
