"""Queries of audits, attempts and access over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, joins, lookups
from ..operators.rollup import final_answers
from ..sources.tables import FINAL_SQL, PAPERS_SQL, SHEETS_SQL, answers, papers, sheets, table


def a31_changed(spark: SparkSession, d: str) -> DataFrame:
    return audit.changed_characters(table(spark, d, "part"), F.col("p_name"), F.translate("p_name", "aeiou", "AEIOU"))


A31 = "WITH c AS (SELECT unnest(string_split(p_name, '')) AS before FROM part) SELECT before, upper(before) AS after, count(*) AS n FROM c WHERE before IN ('a', 'e', 'i', 'o', 'u') GROUP BY 1, 2"


def st3_login_codes(spark: SparkSession, d: str) -> DataFrame:
    return audit.login_codes(table(spark, d, "events"), "user_id", "event_id", F.unix_timestamp("ts"), F.col("event_type") == "purchase", 500000)


ST3 = """WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f AS (SELECT user_id, k, t AS start, 1 AS tries, CASE WHEN ok THEN event_id END AS id FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, f.start, f.tries + CASE WHEN f.id IS NULL AND f.tries < 5 AND o.t - f.start < 500000 THEN 1 ELSE 0 END, CASE WHEN f.id IS NULL AND f.tries < 5 AND o.t - f.start < 500000 AND o.ok THEN o.event_id ELSE f.id END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, arg_max(struct_pack(id), k).id AS accepted, CAST(max(tries) AS INT) AS tries FROM f GROUP BY 1"""


def st10_attempts(spark: SparkSession, d: str) -> DataFrame:
    return audit.attempts(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") != "error")


ST10 = """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), e AS (SELECT user_id, min(k) FILTER (event_type IN ('purchase', 'error')) AS stop FROM o GROUP BY 1)
SELECT o.user_id, count(*) AS attempts, bool_or(event_type = 'purchase') AS succeeded FROM o JOIN e USING (user_id) WHERE k <= 3 AND k <= coalesce(stop, 3) GROUP BY 1"""


def st11_keep_better(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("rows"), F.col("l_partkey").alias("attempt"))
    return audit.keep_better(ledger, ["l_orderkey", "l_linenumber"], "rows", "attempt")


ST11 = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS rows, arg_min(l_partkey, (-l_quantity, l_partkey)) AS attempt, count(*) AS calls FROM lineitem GROUP BY 1, 2"


def t52_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")).otherwise(F.col("l_linenumber") * 100 + F.col("l_partkey") % 9 + 1).alias("n"))
    return audit.numbering_problems(rows, "l_orderkey", "n")


T52 = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS main, count(*) FILTER (l_returnflag <> 'N') AS n_parts FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'N') AND count(*) FILTER (l_returnflag <> 'N') > 0"


def p22_can_codegen(spark: SparkSession, d: str) -> DataFrame:
    return audit.provides_all(table(spark, d, "events"), "user_id", "event_type", ["click", "error", "purchase"])


P22 = "SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase'], lambda x: NOT list_contains(list(DISTINCT event_type), x)), ',') AS lacking, count(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'purchase')) = 3 AS usable FROM events GROUP BY 1"


def p16_needs_advice(spark: SparkSession, d: str) -> DataFrame:
    """Final verdict wrong or partial, with a reference (a part of a known brand) and points to gain."""
    known = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("part_id"))
    return audit.needs_advice(final_answers(answers(spark, d)), known, "part_id").select("sheet_id", "n", "verdict")


P16 = f"WITH {FINAL_SQL} SELECT sheet_id, CAST(n AS INT) AS n, verdict FROM final WHERE verdict IN ('wrong', 'partial') AND score_got < score_full AND part_id IN (SELECT p_partkey FROM part WHERE p_size > 25)"


def p19_invalid(spark: SparkSession, d: str) -> DataFrame:
    return audit.invalid(table(spark, d, "events"), "event_type", ["click", "view", "purchase"]).select("event_id", "event_type")


P19 = "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"


def e6_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(table(spark, d, "events"), "user_id", F.col("value") > 150, "event_type")


E6 = "SELECT user_id, bool_or(value > 150) AS drawn, count(DISTINCT event_type) > 1 AS changes FROM events GROUP BY 1"


def m25_advice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return audit.last_substantial(rows, "conv_id", "turn", "text", F.length("text") < 100).select("conv_id", F.md5("text").alias("text_md5"))


M25 = "WITH g AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), l AS (SELECT conv_id, arg_max(text, turn) AS text FROM g GROUP BY 1) SELECT conv_id, md5(text) AS text_md5 FROM l WHERE length(text) >= 100"


def j3_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed answers of papers of one kind, with the number of others that hang on the same part."""
    wrong = answers(spark, d).where("verdict = 'wrong'")
    return joins.failures(wrong, sheets(spark, d), papers(spark, d).where("kind = 'MACHINERY'"), "part_id").select("paper_id", "sheet_id", "n", "n_same")


J3 = f"WITH {PAPERS_SQL}, {SHEETS_SQL}, {FINAL_SQL} SELECT paper_id, sheet_id, CAST(a.n AS INT) AS n, count(*) OVER (PARTITION BY a.part_id) AS n_same FROM answers a JOIN sheets USING (sheet_id) JOIN papers USING (paper_id) WHERE a.verdict = 'wrong' AND kind = 'MACHINERY'"


def k5_landing(spark: SparkSession, d: str) -> DataFrame:
    """Each paper's first sheet with answers, by status ascending and total descending."""
    return lookups.landing(sheets(spark, d), answers(spark, d), "paper_id", "sheet_id", [F.col("status"), F.desc_nulls_last("total"), F.col("sheet_id")])


K5 = f"WITH {SHEETS_SQL} SELECT paper_id, sheet_id FROM sheets WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = sheet_id) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY status, total DESC NULLS LAST, sheet_id) = 1"


#: a word of each document, with something before it that blames, names a term, or says nothing
_SAID = "concat(CASE doc_id % 7 WHEN 0 THEN '粗心 ' WHEN 1 THEN '动能 ' WHEN 2 THEN '对知识点理解不到位 ' WHEN 3 THEN '= ' ELSE '' END, CASE WHEN doc_id % 11 > 0 THEN split_part(replace(text, chr(10), ' '), ' ', CAST(1 + doc_id % 5 AS INT)) ELSE ' ' END)"


def t49_hollow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.hollow(F.expr(_SAID)).alias("hollow"))


T49 = f"""WITH s AS (SELECT doc_id, {_SAID} AS said FROM documents)
SELECT doc_id, trim(said) = '' OR regexp_matches(said, '{T.BLAME}') OR NOT regexp_matches(said, '{T.CONCRETE.replace("(?![a-z])", "(?:[^a-z]|$)")}') AS hollow FROM s"""

QUERIES = {
    "a31_changed": (a31_changed, A31),
    "st3_login_codes": (st3_login_codes, ST3), "st10_attempts": (st10_attempts, ST10), "st11_keep_better": (st11_keep_better, ST11), "t52_numbering": (t52_numbering, T52), "p22_can_codegen": (p22_can_codegen, P22),
    "p16_needs_advice": (p16_needs_advice, P16), "p19_invalid": (p19_invalid, P19), "e6_coverage": (e6_coverage, E6), "m25_advice": (m25_advice, M25), "j3_failures": (j3_failures, J3), "k5_landing": (k5_landing, K5), "t49_hollow": (t49_hollow, T49),
}
