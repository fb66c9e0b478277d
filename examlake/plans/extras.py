"""Queries of the remaining text functions, lookups, merges and stores over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, lookups, merge, state
from ..sources import store
from ..sources.tables import ANSWERS_SQL, PAPERS_SQL, SHEETS_SQL, answers, papers, sheets, table


def t1_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Texts with radicals, wide spaces and control characters put into them."""
    raw = F.concat(F.lit("⼈　\r\x01"), F.col("p_name"), F.lit("\t\x7f豈\n"))
    return table(spark, d, "part").select("p_partkey", T.normalize(raw).alias("text"))


T1 = "SELECT p_partkey, '人 ' || p_name || chr(9) || chr(127) || '豈' || chr(10) AS text FROM part"


def t28_width(spark: SparkSession, d: str) -> DataFrame:
    """The width of a name with two ideographs, how it overlaps a span, and whether it is near a rule."""
    w = T.width(F.concat(F.col("p_name"), F.lit("長さ長")), F.lit(10.0))
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", w.alias("width"), T.x_overlap(F.lit(10.0), F.lit(30.0), x, x + 15).alias("overlaps"), T.near(x, F.lit(20.0), F.lit(4.0)).alias("near"))


T28 = "SELECT p_partkey, (2 + (length(p_name) + 1) * 0.5) * 10.0 AS width, greatest(least(30.0, p_size + 15) - greatest(10.0, p_size), 0) >= 12.0 AS overlaps, abs(p_size - 20.0) <= 12.0 AS near FROM part"


def t34_cjk_only(spark: SparkSession, d: str) -> DataFrame:
    """Names with ideographs, and those that are no text at all."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("質"), F.col("p_name"), F.lit("量9"))).when(F.col("p_partkey") % 3 == 1, "12 - 3").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.cjk_only(raw).alias("cjk"), T.is_body(raw).alias("body"))


T34 = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '質量' ELSE '' END AS cjk, p_partkey % 3 <> 1 AS body FROM part"


def t37_backslashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.restore_backslashes(F.concat(F.lit("\times \frac \beta \rho "), F.col("p_name"))).alias("tex"))


T37 = r"SELECT p_partkey, '\times \frac \beta \rho ' || p_name AS tex FROM part"


def t39_valid_answer(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of their domain, some of them none."""
    s = sheets(spark, d)
    return s.select("sheet_id", T.valid_answer(F.when(F.col("sheet_id") % 4 > 0, F.col("status")), ["O", "F", "P"]).alias("status"))


T39 = "SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status FROM orders"


def t40_tex(spark: SparkSession, d: str) -> DataFrame:
    """Formulas in brackets, their spans, and a key to compare answers by."""
    tex = T.norm_tex(F.concat(F.col("p_name"), F.lit(r" \(a+b\) and \["), F.col("p_size").cast("string"), F.lit(r"\] $x$")))
    return table(spark, d, "part").select("p_partkey", tex.alias("tex"), F.array_join(T.tex_spans(tex), "|").alias("spans"), T.answer_key(tex).alias("key"))


T40 = r"SELECT p_partkey, p_name || ' $a+b$ and $' || p_size || '$ $x$' AS tex, '$a+b$|$' || p_size || '$|$x$' AS spans, lower(regexp_replace(p_name || 'a+band' || p_size || 'x', '[\s$]+', '', 'g')) AS key FROM part"


def t42_question_text(spark: SparkSession, d: str) -> DataFrame:
    """A name and its two options, or none."""
    options = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_brand"), F.col("p_type"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", T.question_text(F.col("p_name"), options).alias("text"))


T42 = "SELECT p_partkey, p_name || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'A. ' || p_brand || chr(10) || 'B. ' || p_type ELSE '' END AS text FROM part"


def t47_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of any length with parts."""
    raw = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("（"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("p_size") % 5 == 0, "x").otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.any_question_number(raw).alias("n"))


T47 = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_partkey * 100 + p_size ELSE p_partkey END AS n FROM part"


def t53_answer_zone(spark: SparkSession, d: str) -> DataFrame:
    """Where a heading stands, and how many answers follow it."""
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, "\nAnswers\n1. a 2. b ").otherwise(""), F.when(F.col("p_partkey") % 3 == 1, "3. c").otherwise("1. again"))
    zone = T.answer_zone(text, "Answers", r"([0-9]+)\. ")
    return table(spark, d, "part").select("p_partkey", T.zone_start(text, "Answers").alias("start"), F.when(zone.isNotNull(), F.size(zone)).alias("n"))


T53 = "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 > 0 THEN length(p_name) + 1 ELSE -1 END AS INT) AS start, CAST(CASE WHEN p_partkey % 3 = 1 THEN 3 END AS INT) AS n FROM part"


def t55_splice(spark: SparkSession, d: str) -> DataFrame:
    one = lambda s, e, r: F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), r.alias("r"))
    return table(spark, d, "part").select("p_partkey", T.splice(F.concat(F.lit("0123456789"), F.col("p_name")), F.array(one(1, 3, F.col("p_brand")), one(2, 5, F.lit("no")), one(5, 9, F.lit("")))).alias("text"))


T55 = "SELECT p_partkey, '0' || p_brand || '34' || '9' || p_name AS text FROM part"


def t59_email(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in one form, masked, and whether a name is safe in a path."""
    mail = F.concat(F.lit("  "), F.col("name"), F.when(F.col("paper_id") % 3 == 0, "..").otherwise(""), F.lit("@X.org "))
    return papers(spark, d).select("paper_id", T.norm_email(mail).alias("mail"), state.mask(F.trim(mail)).alias("masked"), T.valid_name(F.trim(F.regexp_replace(mail, "@", "-"))).alias("safe"))


T59 = f"WITH {PAPERS_SQL}, m AS (SELECT paper_id, name || CASE WHEN paper_id % 3 = 0 THEN '..' ELSE '' END || '@X.org' AS m FROM papers) SELECT paper_id, lower(m) AS mail, left(m, 4) || '...' || right(m, 4) AS masked, paper_id % 3 <> 0 AND NOT contains(m, '#') AS safe FROM m"


def t60_type_words(spark: SparkSession, d: str) -> DataFrame:
    """How often type words head something, and the beginning of a label."""
    text = F.concat(F.col("p_name"), F.repeat(F.lit(" steel case, steel"), (F.col("p_size") % 3).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.type_words(text, ["steel"]).alias("n"), T.label_prefix(F.concat(F.col("p_brand"), F.lit(", more"))).alias("label"))


T60 = "SELECT p_partkey, CAST(p_size % 3 + len(regexp_extract_all(p_name, 'steel')) AS INT) AS n, left(p_brand, 6) AS label FROM part"


def t74_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a reply, an expression with prefixes, and a known phrase."""
    i = F.col("p_partkey").cast("string")
    reply = F.concat(F.lit("x ===FILE a.js===\n```js\nvar a = "), i, F.lit(";\n```\n===FILE b.exe===\nno\n===FILE c.css===\n.c {}"))
    said = F.when(F.col("p_partkey") % 3 == 0, "Error: Not Logged In").when(F.col("p_partkey") % 3 == 1, "session EXPIRED").otherwise("fine")
    files = T.file_sections(reply)
    return table(spark, d, "part").select("p_partkey", F.map_values(files)[0].alias("js"), F.array_join(F.array_sort(F.map_keys(files)), ",").alias("names"), T.qualify(F.concat(F.lit("v + s.v + u2*case1 - "), i), ["v", "u2", "case1"], ["case1"]).alias("expr"), T.failure_phrase(said, ["expired", "not logged in"]).alias("phrase"))


T74 = "SELECT p_partkey, 'var a = ' || p_partkey || ';' AS js, 'a.js,c.css' AS names, 's.v + s.v + s.u2*case1 - ' || p_partkey AS expr, CASE p_partkey % 3 WHEN 0 THEN 'not logged in' WHEN 1 THEN 'expired' END AS phrase FROM part"


def p2_owner_of(spark: SparkSession, d: str) -> DataFrame:
    return lookups.owner_of(papers(spark, d), "Customer#000000007")


P2 = f"WITH {PAPERS_SQL} SELECT count(*) > 0 AS found, max(owner_id) AS owner_id FROM papers WHERE name = 'Customer#000000007'"


def p4_by_paper(spark: SparkSession, d: str) -> DataFrame:
    """The open sheets of a named paper."""
    first = papers(spark, d).join(sheets(spark, d).groupBy("paper_id").agg(F.count("*").alias("k")), "paper_id").agg(F.max_by("name", F.struct("k", "name")).alias("name"))
    named = papers(spark, d).join(first, "name", "left_semi").withColumn("name", F.lit("chosen"))
    return lookups.by_paper(sheets(spark, d), named, "chosen", ["sheet_id", "status"], F.col("status") == "O")


P4 = f"WITH {PAPERS_SQL}, {SHEETS_SQL}, c AS (SELECT paper_id FROM papers JOIN sheets USING (paper_id) GROUP BY paper_id, name ORDER BY count(*) DESC, name DESC LIMIT 1) SELECT sheet_id, status FROM sheets JOIN c USING (paper_id) WHERE status = 'O'"


def p23_cut_reason(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.cut_reason(F.col("p_size") / 60.0, F.col("p_partkey") % 200).alias("why"))


P23 = "SELECT p_partkey, CASE WHEN p_size / 60.0 < 0.10 THEN 'narrow' WHEN p_partkey % 200 < 60 THEN 'faint' WHEN p_size / 60.0 >= 0.60 THEN 'wide' END AS why FROM part"


def p24_approve(spark: SparkSession, d: str) -> DataFrame:
    """Orders are specifications, their lines outcomes of assertions."""
    outcomes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.when(F.col("l_quantity") < 48, "true").otherwise("false").alias("outcome"))
    return audit.approve(sheets(spark, d).select("sheet_id", "status"), outcomes, "sheet_id")


P24 = f"WITH {SHEETS_SQL} SELECT sheet_id, coalesce((SELECT CASE WHEN max(l_quantity) < 48 THEN 'approved' WHEN max(l_quantity) >= 48 THEN 'rejected' END FROM lineitem WHERE l_orderkey = sheet_id), status) AS status FROM sheets"


def j5_with_question(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("part_id"), "p_brand", "p_name")
    return lookups.with_question(answers(spark, d).select("sheet_id", "n", "part_id"), parts, "part_id", ["p_brand"])


J5 = f"WITH {ANSWERS_SQL} SELECT part_id, sheet_id, CAST(n AS INT) AS n, p_brand FROM answers JOIN part ON p_partkey = part_id WHERE p_size > 20"


def j13_sheet_detail(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their part, and the names of the nations that the part's codes stand for; unknown codes have none."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), "p_brand", F.when(F.col("p_size") % 4 > 0, F.array((F.col("p_size") % 40).cast("long"), F.lit(3).cast("long"))).alias("codes"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("name"))
    out = lookups.sheet_detail(answers(spark, d).select("sheet_id", "n", F.col("part_id").alias("question_id")), parts, names, "codes")
    return out.select("sheet_id", "n", "question_id", "p_brand", F.array_join("topics", ",").alias("topics"))


J13 = f"WITH {ANSWERS_SQL} SELECT sheet_id, CAST(n AS INT) AS n, part_id AS question_id, p_brand, CASE WHEN p_size % 4 > 0 THEN concat_ws(',', a.n_name, b.n_name) ELSE '' END AS topics FROM answers LEFT JOIN part ON p_partkey = part_id LEFT JOIN nation a ON a.n_nationkey = p_size % 40 LEFT JOIN nation b ON b.n_nationkey = 3"


def a5_child_count(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with their lines of large quantity."""
    lines = table(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_suppkey", "s_suppkey")
    return lookups.child_count(table(spark, d, "supplier").select("s_suppkey"), lines, "s_suppkey")


A5 = "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS n_children FROM supplier"


def a24_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Events by what became of them."""
    return lookups.tallies(table(spark, d, "events"), F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 100, "large").otherwise("passed"))


A24 = "SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 100 THEN 'large' ELSE 'passed' END AS outcome, count(*) AS n FROM events GROUP BY 1"


def a28_contrast(spark: SparkSession, d: str) -> DataFrame:
    return lookups.band_contrast(table(spark, d, "events"), "user_id", (F.col("event_id") % 3 == 0) | (F.col("user_id") % 5 == 0), "value").withColumn("contrast", F.round("contrast", 6))


A28 = "SELECT user_id, round(coalesce(avg(value) FILTER (event_id % 3 = 0 OR user_id % 5 = 0) - avg(value) FILTER (NOT (event_id % 3 = 0 OR user_id % 5 = 0)), 0), 6)::DOUBLE AS contrast FROM events GROUP BY 1"


def w4_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as runs: lines are twenty apart, runs of one line up to three."""
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * -20 + F.col("l_partkey") % 3).cast("double").alias("y"), (F.col("l_suppkey") * 1000 + F.col("l_quantity")).cast("double").alias("x"))
    return lookups.reading_order(runs, "page")


W4 = """WITH r AS (SELECT l_orderkey AS page, CAST(l_linenumber * -20 + l_partkey % 3 AS DOUBLE) AS y, CAST(l_suppkey * 1000 + l_quantity AS DOUBLE) AS x, l_linenumber AS k FROM lineitem), l AS (SELECT page, y, x, CAST(dense_rank() OVER (PARTITION BY page ORDER BY k) AS BIGINT) AS line FROM r)
SELECT page, y, x, line, CAST(row_number() OVER (PARTITION BY page ORDER BY line, x, y DESC) AS INT) AS "order" FROM l"""


def m3_replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order replaced by one line, by none, or left."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = table(spark, d, "orders").where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast(old.schema["l_linenumber"].dataType)).alias("l_linenumber"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast(old.schema["l_partkey"].dataType)).alias("l_partkey"))
    return merge.replace_children(old, new, "l_orderkey")


M3 = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 3 = 2 UNION ALL SELECT o_orderkey, 1, -1 FROM orders WHERE o_orderkey % 3 = 0"


def m22_stamp(spark: SparkSession, d: str) -> DataFrame:
    rows = sheets(spark, d).select("sheet_id", "created_at")
    keys = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("sheet_id"))
    return merge.stamp(rows, keys, "sheet_id", "created_at", F.to_timestamp(F.lit("2001-01-01 00:00:00")))


M22 = f"WITH {SHEETS_SQL} SELECT sheet_id, CASE WHEN sheet_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) THEN TIMESTAMP '2001-01-01' ELSE created_at END AS created_at FROM sheets"


def f5_paper_document(spark: SparkSession, d: str) -> DataFrame:
    """what a paper's document holds: how many questions and sheets, the first of both, and its progress."""
    p = papers(spark, d).select("paper_id", "name")
    questions = table(spark, d, "part").select((F.col("p_partkey") % 50).cast(p.schema["paper_id"].dataType).alias("paper_id"), F.col("p_partkey").alias("n"), "p_brand")
    s = sheets(spark, d).select("paper_id", "sheet_id", "status")
    progress = s.groupBy("paper_id").agg(F.count("*").alias("n_sheets"), F.count_if(F.col("status") == "F").alias("n_done"))
    doc = lookups.paper_document(p, questions, s, progress)
    return doc.select("paper_id", "name", F.get("questions", F.lit(0))["p_brand"].alias("first_brand"), F.coalesce(F.size("sheets"), F.lit(0)).alias("n_sheets"), F.get("sheets", F.lit(0))["sheet_id"].alias("first_sheet"), F.col("progress.n_done").alias("n_done"))


F5 = f"""WITH {PAPERS_SQL}, {SHEETS_SQL}, g AS (SELECT paper_id, CAST(count(*) AS INT) AS n, min(sheet_id) AS s, count(*) FILTER (status = 'F') AS f FROM sheets GROUP BY 1), q AS (SELECT p_partkey % 50 AS paper_id, arg_min(p_brand, p_partkey) AS b FROM part GROUP BY 1)
SELECT paper_id, name, b AS first_brand, coalesce(n, 0) AS n_sheets, s AS first_sheet, f AS n_done FROM papers LEFT JOIN g USING (paper_id) LEFT JOIN q USING (paper_id)"""


def f10_gates(spark: SparkSession, d: str) -> DataFrame:
    """the code that refuses to go on, and an error's text where it still counts."""
    i = F.col("sheet_id")
    busy, done = F.col("status") == "O", F.col("status") == "F"
    return sheets(spark, d).select("sheet_id", lookups.resume_gate(i % 5 > 0, busy, done).alias("code"), lookups.failure_note(F.when(i % 2 == 0, F.lit("broke")), busy, done).alias("note"))


F10 = f"WITH {SHEETS_SQL} SELECT sheet_id, CASE WHEN sheet_id % 5 = 0 THEN 404 WHEN status IN ('O', 'F') THEN 409 END AS code, CASE WHEN status = 'P' AND sheet_id % 2 = 0 THEN 'broke' END AS note FROM sheets"


def st12_commands(spark: SparkSession, d: str) -> DataFrame:
    """Orders are commands; those of one clerk's paper name questions, or none."""
    i = F.col("sheet_id")
    text = F.concat(F.lit("run --paper "), F.when(i % 3 == 0, "one").otherwise("two"), F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" --only "), (i % 7).cast("string"), F.lit(",9"))))
    out = lookups.running_commands(sheets(spark, d).select(text.alias("command")), "command", "one")
    return out.select(F.array_join("questions", ",").alias("questions"), "whole")


ST12 = r"""WITH c AS (SELECT 'run --paper ' || CASE WHEN o_orderkey % 3 = 0 THEN 'one' ELSE 'two' END || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' --only ' || o_orderkey % 7 || ',9' END AS command FROM orders),
o AS (SELECT regexp_extract(command, '--only (\d+(?:,\d+)*)', 1) AS named FROM c WHERE contains(command, '--paper one')), q AS (SELECT DISTINCT unnest(string_split(named, ',')) AS q FROM o WHERE named <> '')
SELECT (SELECT string_agg(q, ',' ORDER BY q) FROM q) AS questions, bool_or(named = '') AS whole FROM o"""


def e9_intruders(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "part").select("p_partkey", F.concat(F.lit('<path d="M '), (F.col("p_size") * 3).cast("string"), F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" L -5,"), (-F.col("p_size")).cast("string"), F.lit('"/>')).alias("markup"))
    return lookups.intruders(elements, "markup", 30.0, 90.0, 10.0, 150.0).select("p_partkey")


E9 = "SELECT p_partkey FROM part WHERE p_size * 3 BETWEEN 30 AND 90 AND p_partkey BETWEEN 10 AND 150"


def s9_assets(spark: SparkSession, d: str) -> DataFrame:
    """pages' contents as assets, one object for each different one."""
    files = table(spark, d, "pages").select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".json")).alias("path"), F.regexp_replace("html", "[0-9]", "").cast("binary").alias("content"))
    return store.put_assets(files)


S9 = """WITH f AS (SELECT 'in/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.PNG' ELSE '.json' END AS path, regexp_replace(html, '[0-9]', '', 'g') AS c, CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'application/json' END AS mime FROM pages)
SELECT sha256(c) AS sha256, 'papers/' || left(sha256(c), 2) || '/' || sha256(c) || CASE WHEN ends_with(min(path), '.PNG') THEN '.png' ELSE '.json' END AS object_key, CAST(any_value(strlen(c)) AS INT) AS bytes, min(mime) AS mime, count(*) AS names FROM f GROUP BY c"""


def s13_migrated(spark: SparkSession, d: str) -> DataFrame:
    return store.migrated(table(spark, d, "nation"), "n_nationkey string, N_NAME string, added double").select("n_nationkey", F.col("N_NAME").alias("n_name"), "added")


S13 = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS DOUBLE) AS added FROM nation"


def s17_doc_text(spark: SparkSession, d: str) -> DataFrame:
    return store.doc_text(table(spark, d, "conversations").select("conv_id", F.struct("turn", "role").alias("page"), F.concat_ws(": ", "role", "text").alias("text")), "conv_id", "page", "text").withColumn("text", F.md5("text"))


S17 = "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS text FROM conversations GROUP BY 1"


def s22_cache(spark: SparkSession, d: str) -> DataFrame:
    """Texts looked up in a cache that holds two of three, after new ones have been put."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id"))
    entries = docs.groupBy("sha256").agg(F.min("doc_id").alias("payload"))
    cache = store.cache_put(entries.where("payload % 3 = 0"), entries.where("payload % 3 < 2").withColumn("payload", -F.col("payload")))
    return store.cache_get(docs, cache).select("doc_id", "payload")


S22 = "WITH e AS (SELECT text, min(doc_id) AS p FROM documents GROUP BY 1) SELECT doc_id, CASE p % 3 WHEN 0 THEN p WHEN 1 THEN -p END AS payload FROM documents JOIN e USING (text)"

QUERIES = {
    "t1_normalize": (t1_normalize, T1), "t28_width": (t28_width, T28), "t34_cjk_only": (t34_cjk_only, T34), "t37_backslashes": (t37_backslashes, T37), "t39_valid_answer": (t39_valid_answer, T39), "t40_tex": (t40_tex, T40), "t42_question_text": (t42_question_text, T42),
    "t47_numbers": (t47_numbers, T47), "t53_answer_zone": (t53_answer_zone, T53), "t55_splice": (t55_splice, T55), "t59_email": (t59_email, T59), "t60_type_words": (t60_type_words, T60), "t74_files": (t74_files, T74), "p2_owner_of": (p2_owner_of, P2), "p4_by_paper": (p4_by_paper, P4),
    "p23_cut_reason": (p23_cut_reason, P23), "p24_approve": (p24_approve, P24), "j5_with_question": (j5_with_question, J5), "j13_sheet_detail": (j13_sheet_detail, J13), "a5_child_count": (a5_child_count, A5), "a24_tallies": (a24_tallies, A24), "a28_contrast": (a28_contrast, A28),
    "w4_reading_order": (w4_reading_order, W4), "m3_replace_children": (m3_replace_children, M3), "m22_stamp": (m22_stamp, M22), "f5_paper_document": (f5_paper_document, F5), "f10_gates": (f10_gates, F10), "st12_commands": (st12_commands, ST12), "e9_intruders": (e9_intruders, E9),
    "s9_assets": (s9_assets, S9), "s13_migrated": (s13_migrated, S13), "s17_doc_text": (s17_doc_text, S17), "s22_cache": (s22_cache, S22),
}
