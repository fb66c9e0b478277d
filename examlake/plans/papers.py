"""Queries of whole papers: the bar of stages, progress with jobs, and nested paper documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import papers as P
from ..sources.tables import ANSWERS_SQL, answers, table
from .sheetwork import _CASE, _PROGRESS, _progress

_AT = "1997-06-01"


def _bar(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(c["cell"], F.lit(":"), c["state"])), ",")


#: a bar's states in SQL: of papers from (cur, bad, finished, have) and of sheets from the same
def _states(cells: list[str], needs: set[str]) -> str:
    out = []
    for i, c in enumerate(cells):
        state = f"CASE WHEN bad IS NOT DISTINCT FROM {i} THEN 'fail' WHEN finished THEN 'done' WHEN cur IS NULL THEN CASE WHEN list_contains(have, '{c}') THEN 'done' ELSE 'todo' END WHEN {i} < cur THEN 'done' WHEN {i} > cur THEN 'todo' ELSE 'now' END"
        if c in needs:
            state = f"CASE WHEN {state} IN ('now', 'fail') THEN {state} WHEN list_contains(have, '{c}') THEN 'done' WHEN {state} = 'done' THEN 'empty' ELSE {state} END"
        out.append(f"'{c}:' || {state}")
    return " || ',' || ".join(out)


_PAPER_BAR, _SHEET_BAR = _states(["ingest", "segment", "solve", "spec", "scene", "assemble"], {"scene", "assemble"}), _states(["refread", "kpmark"], set())
_AT_CELL = "CASE {0} WHEN 'ingest' THEN 0 WHEN 'segment' THEN 1 WHEN 'solve' THEN 2 WHEN 'outline' THEN 2 WHEN 'kpmark' THEN CASE WHEN mode = 'sheet' THEN 1 ELSE 2 END WHEN 'pick' THEN 3 WHEN 'spec' THEN 3 WHEN 'check' THEN 3 WHEN 'scene' THEN 4 WHEN 'assemble' THEN 5 WHEN 'refread' THEN 0 END"
_IN_MODE = "CASE WHEN mode = 'sheet' AND {0} NOT IN ('refread', 'kpmark') THEN NULL WHEN mode = 'paper' AND {0} = 'refread' THEN NULL ELSE {0} END"


def _kind(key: str) -> Column:
    return F.when(F.col(key) % 3 == 0, "answers_only").when(F.col(key) % 3 == 1, "pdf")


def f5_bar(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers of both modes, at any stage, failed at some, with what scenes and pages they left."""
    stages = F.array(*map(F.lit, ("solve", "outline", "kpmark", "pick", "spec", "check", "scene", "assemble", "done")))
    k = F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") != "P", F.element_at(stages, (k % 9 + 1).cast("int")))
    failed = F.when(F.col("o_totalprice") > 150000, F.element_at(F.array(*map(F.lit, ("ingest", "scene", "refread", "kpmark"))), (k % 4 + 1).cast("int")))
    have = F.array_compact(F.array(F.when(k % 2 == 0, "scene"), F.when(k % 5 == 0, "assemble"), F.when(k % 7 < 3, "refread")))
    papers = table(spark, d, "orders").select("*", k.alias("paper_id"), _kind("o_orderkey").alias("source_kind"))
    return P.cells(papers, stage, failed, have).select("paper_id", "mode", _bar(F.col("cells")).alias("cells"))


F5 = f"""WITH o AS (SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sheet' ELSE 'paper' END AS mode, CASE WHEN o_orderstatus <> 'P' THEN ['solve', 'outline', 'kpmark', 'pick', 'spec', 'check', 'scene', 'assemble', 'done'][o_orderkey % 9 + 1] END AS stage,
 CASE WHEN o_totalprice > 150000 THEN ['ingest', 'scene', 'refread', 'kpmark'][o_orderkey % 4 + 1] END AS failed, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'scene' END, CASE WHEN o_orderkey % 5 = 0 THEN 'assemble' END, CASE WHEN o_orderkey % 7 < 3 THEN 'refread' END], lambda x: x IS NOT NULL) AS have FROM orders),
s AS (SELECT paper_id, mode, have, coalesce(stage = 'done', false) AS finished, {_IN_MODE.format("stage")} AS s, {_IN_MODE.format("failed")} AS f FROM o), t AS (SELECT *, CASE WHEN NOT finished THEN {_AT_CELL.format("s")} END AS cur, {_AT_CELL.format("f")} AS bad FROM s)
SELECT paper_id, mode, CASE WHEN mode = 'sheet' THEN {_SHEET_BAR} ELSE {_PAPER_BAR} END AS cells FROM t"""


def f7_progress(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers with the counts of their lines; lines are jobs too, some live, some failed."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.to_timestamp("o_orderdate").alias("changed_at"), _kind("o_orderkey").alias("source_kind"))
    counts = _progress(spark, d).withColumnRenamed("sheet_id", "paper_id").withColumn("scenes", F.col("scene_tried") % 2)
    jobs = answers(spark, d).select(
        F.col("sheet_id").alias("paper_id"), F.col("n").alias("job"), (F.col("part_id") % 7 == 0).alias("live"), F.when(F.col("verdict") == "wrong", F.concat(F.lit("error "), F.col("n").cast("string"))).alias("error"),
        F.when(F.col("part_id") % 3 > 0, F.element_at(F.array(*map(F.lit, ("segment", "scene", "kpmark"))), (F.col("n") % 3 + 1).cast("int"))).alias("error_stage"), F.concat(F.lit("step "), F.col("part_id").cast("string")).alias("step"), (F.col("n") % 4).alias("page_done"), F.lit(4).alias("page_total"),
    )
    got = P.progress(orders.select("paper_id", "source_kind"), counts.join(orders.select("paper_id", "changed_at"), "paper_id"), jobs, F.lit(_AT).cast("timestamp"), quiet=86400 * 30)
    return got.withColumn("cells", _bar(F.col("cells")))


F7 = f"""WITH {_PROGRESS}, {ANSWERS_SQL},
j AS (SELECT sheet_id, arg_max(CASE WHEN verdict = 'wrong' THEN 'error ' || n ELSE '' END, n) AS error, arg_max(CASE WHEN part_id % 3 > 0 THEN ['segment', 'scene', 'kpmark'][n % 3 + 1] ELSE '' END, n) AS error_stage, bool_or(part_id % 7 = 0) AS live,
 arg_max('step ' || part_id, CASE WHEN part_id % 7 = 0 THEN n END) AS step, arg_max(n % 4, CASE WHEN part_id % 7 = 0 THEN n END) AS page_done FROM answers GROUP BY 1),
s AS (SELECT pg.*, o_orderkey AS paper_id, o_orderdate AS changed, CASE WHEN o_orderkey % 3 = 0 THEN 'sheet' ELSE 'paper' END AS mode, CASE {_CASE[0]} ELSE 'done' END AS a, CASE {_CASE[1]} ELSE 1 END AS b, CASE {_CASE[2]} ELSE 1 END AS c, coalesce(kps_judged, kps) AS k FROM pg JOIN orders ON o_orderkey = sheet_id),
m AS (SELECT s.*, j.* EXCLUDE (sheet_id), CASE WHEN mode = 'paper' THEN a WHEN k < questions THEN 'kpmark' ELSE 'done' END AS stage, CASE WHEN mode = 'paper' THEN b WHEN k < questions THEN k ELSE 1 END AS done, CASE WHEN mode = 'paper' THEN c WHEN k < questions THEN questions ELSE 1 END AS total FROM s JOIN j USING (sheet_id)),
e AS (SELECT *, stage = 'done' AS finished, live OR epoch(TIMESTAMP '{_AT}') - epoch(changed) < 86400 * 30 AS busy FROM m),
f AS (SELECT *, CASE WHEN NOT busy AND NOT finished AND error <> '' THEN error END AS failed, CASE WHEN NOT busy AND NOT finished AND error <> '' AND error_stage <> '' THEN error_stage END AS failed_stage FROM e),
w AS (SELECT *, {_IN_MODE.format("failed_stage")} AS fs, list_filter([CASE WHEN scene_tried % 2 > 0 THEN 'scene' END, CASE WHEN assembled_fresh THEN 'assemble' END], lambda x: x IS NOT NULL) AS have FROM f), t AS (SELECT *, CASE WHEN NOT finished THEN {_AT_CELL.format("stage")} END AS cur, {_AT_CELL.format("fs")} AS bad FROM w)
SELECT paper_id, mode, stage, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, finished, busy, failed, failed_stage, step, CAST(page_done AS INT) AS page_done, CASE WHEN live THEN 4 END AS page_total, CASE WHEN mode = 'sheet' THEN {_SHEET_BAR} ELSE {_PAPER_BAR} END AS cells FROM t"""


def f9_paper(spark: SparkSession, d: str) -> DataFrame:
    """Customers are papers, orders their questions, lines the questions' options, tables and topics; each nested row is told by what it holds."""
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    key = [F.col("o_custkey").alias("paper_id"), k.alias("n")]
    lines = answers(spark, d).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("line"), "part_id"))).alias("lines"))
    kps = F.transform(F.filter("lines", lambda x: x["part_id"] % 4 == 0), lambda x: F.struct(F.concat(F.lit("k"), (x["part_id"] % 9).cast("string")).alias("code"), F.lit("w").alias("why")))
    size = F.concat((k % 13).cast("string"), F.lit(" m"))
    # lines go to their questions once; what questions hold is made and put together there
    whole = orders.join(lines, k == F.col("sheet_id"), "left").select(*key, F.when(k % 5 > 0, size).alias("ref_answer"), kps.alias("kps"), "lines").repartition("paper_id", "n")
    questions = whole.drop("lines")
    a = whole.select("paper_id", "n", F.explode("lines").alias("l")).select("paper_id", "n", "l.line", "l.part_id")
    options = a.where("line <= 4").select("paper_id", "n", F.col("line").alias("ord"), F.col("part_id").cast("string").alias("text"))
    root = F.when(F.col("line") % 3 == 2, F.col("line") - 1)
    cells = F.when(F.col("part_id") % 3 > 0, F.array(F.array(F.col("part_id").cast("string"))))
    tables = a.select("paper_id", "n", F.col("line").alias("id"), root.alias("cont_of"), F.col("line").alias("ord"), F.lit("t").alias("caption"), F.lit("i").alias("image"), cells.alias("rows"))
    solutions = orders.where("o_orderkey % 4 > 0").select(*key, F.when(k % 3 > 0, size).otherwise("99 m").alias("short_answer"), F.when(k % 6 == 0, "draft").alias("spec_status"))
    failures = orders.where("o_orderkey % 4 = 0 AND o_orderkey % 8 > 0").select(*key, F.lit("too long").alias("reason"))
    scenes = orders.where("o_orderkey % 10 = 1").select(*key, F.col("o_orderstatus").alias("scene_id"))
    vocabulary = table(spark, d, "nation").where("n_nationkey < 6").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.lit("c").alias("chapter"))
    c = F.col("c_custkey")
    papers = table(spark, d, "customer").select(
        c.alias("paper_id"), _kind("c_custkey").alias("source_kind"), F.when(c % 2 == 0, F.array("c_mktsegment")).alias("sections"), F.lit(None).cast("array<string>").alias("warnings"), F.when(c % 5 > 0, F.dateadd(F.lit("1996-01-01").cast("date"), (c % 30).cast("int"))).alias("assembled_at"), (c % 7 > 0).alias("on_disk"), F.lit("1996-01-15").cast("date").alias("changed_at"),
    )
    sheet_rows = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("paper_id"), k.alias("sheet_id"), "o_orderstatus")
    jobs = orders.select(F.col("o_custkey").alias("paper_id"), k.alias("job"), (F.col("o_orderstatus") == "P").alias("live"))
    view = P.paper_view(papers, P.question_view(questions, options, tables, solutions, failures, scenes, vocabulary), sheet_rows, jobs)
    told = F.transform("questions", lambda q: F.concat_ws("/", q["n"].cast("string"), F.array_join(F.transform(q["options"], lambda o: o["text"]), "+"), F.array_join(F.transform(q["tables"], lambda t: F.concat(t["id"].cast("string"), F.lit("="), F.array_join(F.flatten(t["rows"]), "+"))), ";"), F.array_join(F.transform(q["topics"], lambda t: t["name"]), "+"), F.coalesce(q["agrees"].cast("string"), F.lit("?"))))
    flags = F.concat_ws(",", *[F.when(F.col(f"stages.{s}"), s) for s in ("ingest", "segment", "solve", "spec", "scene", "assemble")])
    return view.select("paper_id", "mode", F.size("sections").alias("n_sections"), F.md5(F.array_join(told, "|")).alias("questions_md5"), flags.alias("stages"), "assemble_note", _bar(F.col("cells")).alias("cells"), F.size("sheets").alias("n_sheets"), "job", "coverage.solved", "coverage.failed", "coverage.total")


F9 = f"""WITH {ANSWERS_SQL}, a AS (SELECT answers.*, o_custkey AS paper_id FROM answers JOIN orders ON o_orderkey = sheet_id),
o AS (SELECT o_custkey AS paper_id, o_orderkey AS n, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 13 END AS ref, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 > 0 THEN o_orderkey % 13 ELSE 99 END AS short FROM orders),
op AS (SELECT sheet_id AS n, string_agg(CAST(part_id AS VARCHAR), '+' ORDER BY n) AS x FROM a WHERE n <= 4 GROUP BY 1),
tb AS (SELECT r.sheet_id, r.n, r.part_id, CASE WHEN r.n % 3 = 2 AND r.part_id % 3 > 0 AND p.part_id % 3 > 0 THEN p.n ELSE r.n END AS id FROM a r LEFT JOIN a p ON p.sheet_id = r.sheet_id AND p.n = r.n - 1),
tt AS (SELECT sheet_id, id, id || '=' || string_agg(CAST(part_id AS VARCHAR), '+' ORDER BY n) AS x FROM tb WHERE part_id % 3 > 0 GROUP BY 1, 2), ta AS (SELECT sheet_id AS n, string_agg(x, ';' ORDER BY id) AS x FROM tt GROUP BY 1),
tp AS (SELECT sheet_id AS n, string_agg(coalesce(n_name, 'k' || part_id % 9), '+' ORDER BY n) AS x FROM a LEFT JOIN nation ON n_nationkey = part_id % 9 AND n_nationkey < 6 WHERE part_id % 4 = 0 GROUP BY 1),
q AS (SELECT o.*, concat_ws('/', CAST(o.n AS VARCHAR), coalesce(op.x, ''), coalesce(ta.x, ''), coalesce(tp.x, ''), CASE WHEN ref IS NULL OR short IS NULL THEN '?' ELSE CAST(ref = short AS VARCHAR) END) AS told, tp.x IS NOT NULL AS topical FROM o LEFT JOIN op USING (n) LEFT JOIN ta USING (n) LEFT JOIN tp USING (n)),
g AS (SELECT paper_id, md5(string_agg(told, '|' ORDER BY n)) AS questions_md5, count(*) AS total, count(short) AS solved, count(*) FILTER (n % 4 = 0 AND n % 8 > 0) AS failed, count(*) FILTER (n % 10 = 1) AS scenes, bool_or(n % 4 > 0 AND n % 6 = 0) AS specs, bool_and(topical) AS topical, count(*) FILTER (n % 2 = 0) AS n_sheets, max(n) FILTER (status = 'P') AS job FROM q GROUP BY 1),
p AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN 'sheet' ELSE 'paper' END AS mode, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n_sections, questions_md5, coalesce(total, 0) AS total, coalesce(solved, 0) AS solved, coalesce(failed, 0) AS failed, coalesce(scenes, 0) AS scenes, coalesce(specs, false) AS specs, coalesce(topical, false) AS topical, nullif(n_sheets, 0) AS sheets, job,
 CASE WHEN c_custkey % 5 = 0 THEN 'not assembled' WHEN c_custkey % 7 = 0 THEN 'page is gone' WHEN c_custkey % 30 < 14 THEN 'page is stale' ELSE 'page is fresh' END AS assemble_note FROM customer LEFT JOIN g ON c_custkey = g.paper_id),
h AS (SELECT *, list_filter(['ingest', 'segment', CASE WHEN solved > 0 THEN 'solve' END, CASE WHEN specs THEN 'spec' END, CASE WHEN scenes > 0 THEN 'scene' END, CASE WHEN assemble_note = 'page is fresh' THEN 'assemble' END], lambda x: x IS NOT NULL) AS st, NULL AS cur, NULL AS bad, false AS finished FROM p),
t AS (SELECT *, CASE WHEN mode = 'sheet' THEN list_filter([CASE WHEN total > 0 THEN 'refread' END, CASE WHEN total > 0 AND topical THEN 'kpmark' END], lambda x: x IS NOT NULL) ELSE st END AS have FROM h)
SELECT paper_id, mode, n_sections, questions_md5, array_to_string(st, ',') AS stages, assemble_note, CASE WHEN mode = 'sheet' THEN {_SHEET_BAR} ELSE {_PAPER_BAR} END AS cells, CAST(CASE WHEN mode = 'sheet' THEN sheets END AS INT) AS n_sheets, job, solved, failed, total FROM t"""

QUERIES = {"f5_bar": (f5_bar, F5), "f7_progress": (f7_progress, F7), "f9_paper": (f9_paper, F9)}
