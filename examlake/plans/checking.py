"""Queries of checks of questions, specifications, scenes and logs over texts made of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, checks, series
from ..sources.tables import table

_FORMULA = "[A-Za-zΩωπρμ]\\s?[0-9]{2,}|\\][0-9]+|[0-9]+[A-Za-z]{1,2}[0-9]+"


def _balanced(text: str) -> str:
    return f"list_reduce(list_prepend(0, list_transform(string_split(regexp_replace({text}, '[^()（）]', '', 'g'), ''), lambda c: CASE WHEN c IN ('(', '（') THEN 1 WHEN c IN (')', '）') THEN -1 ELSE 0 END)), lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END) = 0"


def t20_text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stems, with options that are figures, empty, or text."""
    k = F.col("doc_id") % 4
    option = lambda text, figure: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(figure).alias("figure")) for t in text])
    options = F.when(k == 0, option(("", "", " ", "b"), True)).when(k == 1, option(("", "", "", ""), False)).when(k == 2, option(("m12", "b", "c", "d"), False)).otherwise(F.array().cast("array<struct<text:string,figure:boolean>>"))
    return table(spark, d, "documents").select("doc_id", T.text_quality(F.col("text"), options).alias("q"), T.balanced(F.col("text")).alias("balanced")).select("doc_id", "q.grade", "q.reason", "balanced")


T20 = f"""WITH h AS (SELECT doc_id, text, len(regexp_extract_all(text || ' ' || CASE WHEN doc_id % 4 = 2 THEN 'm12 b c d' ELSE '' END, '{_FORMULA}')) AS k FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ok' WHEN k >= 4 OR doc_id % 4 = 1 THEN 'degraded' WHEN k > 0 THEN 'suspect' ELSE 'ok' END AS grade,
 CASE WHEN doc_id % 4 = 0 THEN 'figures' WHEN k >= 4 THEN 'flattened' WHEN doc_id % 4 = 1 THEN 'no option text' WHEN k > 0 THEN 'indices lost' ELSE '' END AS reason, {_balanced("text")} AS balanced FROM h"""


def t21_flat_hits(spark: SparkSession, d: str) -> DataFrame:
    """Part names with formulas put to them: flattened ones, and a function and its argument."""
    text = F.concat(F.col("p_name"), F.lit(" v12 sin37 = cos"), F.col("p_size").cast("string"), F.lit(" 3ab4 ]7"), F.repeat(F.lit(" x10"), (F.col("p_partkey") % 3).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.flat_hits(text).alias("n"))


T21 = "SELECT p_partkey, CAST(3 + p_partkey % 3 AS INT) AS n FROM part"


def _tables(k: Column) -> Column:
    one = lambda i, of, *w: F.struct(F.lit(i).alias("id"), F.lit(of).cast("int").alias("cont_of"), F.array(*map(F.lit, w)).cast("array<int>").alias("widths"))
    two = F.array(one(1, None, 2, 2))
    none = F.array().cast("array<struct<id:int,cont_of:int,widths:array<int>>>")
    return F.when(k.isin(1, 2), two).when(k == 3, F.array(one(1, None, 2, 2), one(2, 1, 3))).when(k == 4, F.array(one(1, None), one(2, 1, 2))).when(k == 5, F.array(one(1, None, 2, 3))).otherwise(none)


def t23_check_questions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stems, with options, tables and formulas that break one rule or another."""
    i = F.col("doc_id")
    stem = F.concat("text", F.when(i % 11 == 0, " 单选题").otherwise(""), F.when(i % 13 == 0, " x^(2)").otherwise(""), F.when(i % 17 == 0, " /").otherwise(""))
    option = lambda key, text: F.struct(F.lit(key).alias("key"), text.alias("text"), F.array().cast("array<string>").alias("math"))
    options = F.when(i % 3 == 0, F.array(option("A", F.lit("x")), option("B", F.lit("(y")), option("C", F.when(i % 2 == 0, "x").otherwise("z")), option("D", F.lit(" ")))).otherwise(F.array().cast("array<struct<key:string,text:string,math:array<string>>>"))
    latex = F.when(i % 6 != 2, F.concat(F.lit("〔表1〕"), stem))
    math = F.when(i % 7 == 0, F.array(F.lit("<math><mrow></math>"), F.lit("<math></math>"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "documents").select("doc_id", stem.alias("stem"), options.alias("options"), F.when(i % 5 < 2, "单选题").otherwise("解答题").alias("type"), _tables(i % 6).alias("tables"), latex.alias("latex"), math.alias("math"))
    found = checks.question_faults(F.col("stem"), F.col("options"), F.col("type"), F.lit(None).cast("int"), F.col("tables"), F.col("latex"), F.col("math"))
    return rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", "f.message")


T23 = f"""WITH q AS (SELECT doc_id AS i, text || CASE WHEN doc_id % 11 = 0 THEN ' 单选题' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' x^(2)' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN ' /' ELSE '' END AS stem FROM documents),
s AS (SELECT *, trim(stem) <> '' AS there FROM q)
SELECT i AS doc_id, 'structure' AS kind, 'short' AS message FROM s WHERE length(stem) < 25 AND i % 3 > 0
UNION ALL SELECT i, 'structure', 'long' FROM s WHERE length(stem) > 900 UNION ALL SELECT i, 'structure', 'options' FROM s WHERE i % 5 < 2 AND i % 3 > 0 UNION ALL SELECT i, 'structure', 'same options' FROM s WHERE i % 6 = 0
UNION ALL SELECT i, 'structure', 'type word inside' FROM s WHERE i % 11 = 0 AND contains(substr(stem, 21), '单选题') UNION ALL SELECT i, 'table', 'placeholders' FROM s WHERE i % 6 = 2 UNION ALL SELECT i, 'table', 'other width 2' FROM s WHERE i % 6 = 3
UNION ALL SELECT i, 'table', unnest(['half empty 2', 'no content 1']) FROM s WHERE i % 6 = 4 UNION ALL SELECT i, 'table', 'ragged 1' FROM s WHERE i % 6 = 5
UNION ALL SELECT i, 'formula', 'stem brackets' FROM s WHERE there AND NOT ({_balanced("stem")}) UNION ALL SELECT i, 'formula', 'stem flattened' FROM s WHERE regexp_matches(stem, '{_FORMULA}') UNION ALL SELECT i, 'formula', 'stem fallback' FROM s WHERE contains(stem, '^(') OR contains(stem, '_(')
UNION ALL SELECT i, 'formula', 'stem empty fraction' FROM s WHERE there AND regexp_matches(stem, '\\(\\)/|/\\(\\)|/\\s*$|^\\s*/') UNION ALL SELECT i, 'formula', 'stem mathml' FROM s WHERE there AND i % 7 = 0 UNION ALL SELECT i, 'formula', 'option B brackets' FROM s WHERE i % 3 = 0"""


def a16_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(t23_check_questions(spark, d), table(spark, d, "documents"), "doc_id")


A16 = f"WITH f AS ({T23}) SELECT kind, count(*) AS n_findings, count(DISTINCT doc_id) AS n_flagged, round(count(DISTINCT doc_id) * 100.0 / (SELECT count(*) FROM documents), 4)::DOUBLE AS percent FROM f GROUP BY 1"

_EXPRS = ("all(diff(v) > 0)", "v[-1] > 3e2", "v > 0.0", "q + v", "", "a[argmax(v)] < 1e-9")


def t58_spec_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders are specifications, their lines assertions."""
    k = F.col("l_suppkey") % 6
    expr = F.element_at(F.array(*map(F.lit, _EXPRS)), (k + 1).cast("int"))
    one = F.struct(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_partkey") % 3 == 0, "c1").when(F.col("l_partkey") % 3 == 1, "c9").otherwise("").alias("case"), expr.alias("expr"), F.when(F.col("l_tax") > 0.06, "").otherwise("w").alias("why"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("invariants"))
    keys = F.when(F.col("l_orderkey") % 13 == 0, F.array().cast("array<string>")).when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("v"), F.lit("a"))).otherwise(F.array(F.lit("v")))
    faults = checks.spec_faults(keys, F.array(F.lit("c1"), F.lit("c2")), F.array(F.lit("g")), F.col("invariants"))
    return per.select("l_orderkey", F.explode(faults).alias("fault")).groupBy("l_orderkey", "fault").agg(F.count("*").alias("n"))


T58 = rf"""WITH l AS (SELECT l_orderkey AS o, 'L' || l_linenumber AS id, CASE l_partkey % 3 WHEN 0 THEN 'c1' WHEN 1 THEN 'c9' ELSE '' END AS c, coalesce([{", ".join("NULL" if e is None else "'" + e.replace("'", "''") + "'" for e in _EXPRS)}][l_suppkey % 6 + 1], '') AS e, CASE WHEN l_tax > 0.06 THEN '' ELSE 'w' END AS why,
 CASE WHEN l_orderkey % 13 = 0 THEN [] WHEN l_orderkey % 2 = 0 THEN ['v', 'a'] ELSE ['v'] END AS keys FROM lineitem),
n AS (SELECT *, list_filter(list_sort(list_distinct(regexp_extract_all(regexp_replace(e, '\b\d+\.?\d*([eE][+-]?\d+)?\b', ' ', 'g'), '[A-Za-z_][A-Za-z_0-9]*'))), lambda x: NOT list_contains(['{"', '".join([*checks.FUNCTION_NAMES, *checks.KEYWORDS, "g"])}'], x) AND NOT list_contains(keys, x)) AS names FROM l),
f AS (SELECT o, 'no keys' AS f FROM l WHERE len(keys) = 0 GROUP BY o UNION ALL SELECT o, 'id twice: ' || id FROM (SELECT o, id, row_number() OVER (PARTITION BY o, id) AS r FROM l) WHERE r > 1
 UNION ALL SELECT o, 'no case: ' || id FROM l WHERE c = '' UNION ALL SELECT o, 'no expr: ' || id FROM l WHERE e = '' UNION ALL SELECT o, 'no why: ' || id FROM l WHERE why = '' UNION ALL SELECT o, 'unknown case: ' || id FROM l WHERE c NOT IN ('', 'c1', 'c2')
 UNION ALL SELECT o, 'unknown names: ' || id || ' ' || array_to_string(names, ',') FROM n WHERE len(names) > 0 UNION ALL SELECT o, 'no comparison: ' || id FROM l WHERE NOT regexp_matches(e, '[<>=]') UNION ALL SELECT o, 'only against 0: ' || id FROM l WHERE regexp_full_match(trim(e), '[\w\[\]\-.]+\s*[<>]=?\s*0(\.0*)?')
 UNION ALL SELECT o, 'no test of change' FROM l GROUP BY o HAVING NOT bool_or(contains(e, 'diff(') OR contains(e, 'std(')) UNION ALL SELECT o, 'no test of an end' FROM l GROUP BY o HAVING NOT bool_or(contains(e, '[-1]'))
 UNION ALL SELECT o, 'untied: v a' FROM l GROUP BY o HAVING bool_and(len(keys) = 2) AND NOT bool_or(contains(e, 'a') AND (contains(e, 'argmin(v)') OR contains(e, 'argmax(v)'))))
SELECT o AS l_orderkey, f AS fault, count(*) AS n FROM f GROUP BY 1, 2"""


def t57_names_in(spark: SparkSession, d: str) -> DataFrame:
    """Names in expressions made of sizes, brands and numbers with exponents."""
    e = F.concat(F.lit("max(v"), F.col("p_size").cast("string"), F.lit(") > 1.5e-9 and "), F.regexp_replace("p_brand", "#", "_"), F.lit(" in x or 2e3 < x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(checks.names_in(e), ",").alias("names"))


T57 = "SELECT p_partkey, array_to_string(list_sort(['max', 'v' || p_size, replace(p_brand, '#', '_'), 'x']), ',') AS names FROM part"


def e7_scene_faults(spark: SparkSession, d: str) -> DataFrame:
    """Parts are scenes, whose markup and script break one rule or another; how often each code is reported."""
    i, sid = F.col("p_partkey"), F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    some = lambda n, text: F.when(i % n == 0, F.lit(text)).otherwise(F.lit(""))
    markup = F.concat(
        F.when(i % 5 == 0, "<div>").otherwise(F.concat(F.lit('<figure class="f" data-scene="'), F.when(i % 7 == 0, F.lit("other")).otherwise(sid), F.lit('">'))),
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.when(i % 4 == 0, "640").otherwise("560"), F.lit(' 300"><g id="'), sid, F.lit('-a"/><g marker-end="url(#k)"/>'), some(6, '<g id="loose"/>'), some(9, "<style></style>"), some(10, '<image src="https://x/y"/>'),
        some(11, "<animate/>"), some(12, '<g fill="#aabbcc"/>'), F.lit('<text class="t" x="500">'), F.when(i % 8 == 0, "long enough").otherwise("short"), F.lit("</text>"), F.when(i % 3 == 0, "").otherwise("must be said"),
    )
    script = F.concat(F.lit("window.Scenes['"), F.when(i % 13 == 0, F.lit("none")).otherwise(sid), F.lit("'] = function(fig) { fig.querySelector('#"), sid, F.when(i % 14 == 0, "-b").otherwise("-a"), F.lit("'); "), some(15, "setTimeout(f, 1); "), some(16, "const x = () => 1; "), F.lit("};"))
    faults = checks.scene_faults(sid, markup, script, F.array(F.lit("must be said")))
    return table(spark, d, "part").select("p_partkey", F.explode(faults).alias("code")).groupBy("p_partkey", "code").agg(F.count("*").alias("n"))


E7 = """WITH r AS (SELECT p_partkey AS i, unnest(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'no-figure' WHEN p_partkey % 7 = 0 THEN 'scene-id' END, CASE WHEN p_partkey % 4 = 0 THEN 'viewbox' END, CASE WHEN p_partkey % 6 = 0 THEN 'id-prefix' END, CASE WHEN p_partkey % 9 = 0 THEN 'illegal' END, CASE WHEN p_partkey % 10 = 0 THEN 'illegal' END,
 CASE WHEN p_partkey % 11 = 0 THEN 'smil' END, CASE WHEN p_partkey % 12 = 0 THEN 'color' END, CASE WHEN p_partkey % 8 = 0 THEN 'overflow' END, CASE WHEN p_partkey % 3 = 0 THEN 'disclosure' END, CASE WHEN p_partkey % 13 = 0 THEN 'register' END, CASE WHEN p_partkey % 14 = 0 THEN 'dangling-id' END, CASE WHEN p_partkey % 15 = 0 THEN 'timer' END,
 CASE WHEN p_partkey % 16 = 0 THEN 'es5' END, CASE WHEN p_partkey % 16 = 0 THEN 'es5' END], lambda x: x IS NOT NULL)) AS code FROM part)
SELECT i AS p_partkey, code, count(*) AS n FROM r GROUP BY 1, 2"""


def e5_dirty_tokens(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat("html", F.when(F.col("page_id") % 3 == 0, " NaN null NaN").otherwise(" undefined"))
    return table(spark, d, "pages").select("page_id", checks.dirty_tokens(shown).alias("t")).select("page_id", F.col("t.NaN").alias("nan"), F.col("t.Infinity").alias("infinity"), F.col("t.undefined").alias("undefined_"), F.col("t.null").alias("null_"))


E5 = """WITH s AS (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN ' NaN null NaN' ELSE ' undefined' END AS t FROM pages)
SELECT page_id, len(regexp_extract_all(t, 'NaN')) AS nan, len(regexp_extract_all(t, 'Infinity')) AS infinity, len(regexp_extract_all(t, 'undefined')) AS undefined_, len(regexp_extract_all(t, 'null')) AS null_ FROM s"""

ASSERTIONS = [
    ("rising", "all(diff(t) > 0)"), ("bounded", "max(v) < limit"), ("swings", "max(abs(diff(v))) > 100"), ("ends", "v[-1] >= v[0]"), ("middle", "mean(v) > 80"), ("total", "sum(clip(v, 0, 50)) > 9 * pi"), ("finite", "isfinite(v)"),
    ("logs", "exp(log(max(v))) > max(v) / 2"), ("unknown", "max(q) > 0"), ("broken", "v >"), ("banned", "v.sum() > 0"),
]


def e1_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user are a case; limits are constants, and two of the assertions cannot be evaluated."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("v"))
    return series.check(rows, "user_id", "event_id", ["t", "v"], ASSERTIONS, {"limit": 400.0}).drop("report")


E1 = """WITH s AS (SELECT user_id, value AS v, value - lag(value) OVER w AS dv, event_id - lag(event_id) OVER w AS dt, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT user_id, bool_and(coalesce(dt > 0, true)) AS rising, max(v) < 400 AS bounded, coalesce(max(abs(dv)) > 100, false) AS swings, arg_max(v, event_id) >= arg_min(v, event_id) AS ends, avg(v) > 80 AS middle, sum(least(greatest(v, 0), 50)) > 9 * pi() AS total, count(*) AS n FROM s GROUP BY 1)
SELECT user_id, unnest(['rising', 'bounded', 'swings', 'ends', 'middle', 'total', 'finite', 'logs', 'unknown', 'broken', 'banned']) AS id,
 unnest([CAST(rising AS VARCHAR), CAST(bounded AS VARCHAR), CASE WHEN n = 1 THEN 'error' ELSE CAST(swings AS VARCHAR) END, CAST(ends AS VARCHAR), CAST(middle AS VARCHAR), CAST(total AS VARCHAR), 'true', 'true', 'unknown name', 'error', 'error']) AS outcome FROM g"""


def a18_readouts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of an order are the keys of its panel; reports mention them once for each line."""
    key = F.concat(F.lit("k"), (F.col("l_suppkey") % 9).cast("string"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(key)).alias("keys"), F.collect_list(F.concat(F.lit("max("), key, F.lit(") - u"))).alias("reports"))
    declared = F.when(F.col("l_orderkey") % 5 == 0, F.slice("keys", 1, 2))
    shown = checks.readouts(F.concat(F.array(F.lit("u")), F.col("keys")), F.array(F.lit("k3")), F.col("reports"), declared)
    return per.select("l_orderkey", F.array_join(shown, ",").alias("shown"))


A18 = """WITH k AS (SELECT l_orderkey AS o, 'k' || l_suppkey % 9 AS key, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT o, CASE WHEN o % 5 = 0 THEN list(key ORDER BY key)[1:2] ELSE coalesce(list(key ORDER BY n DESC, key) FILTER (key <> 'k3'), [])[1:4] END AS s FROM k GROUP BY o)
SELECT o AS l_orderkey, array_to_string(s, ',') AS shown FROM r"""


def a19_fail_digest(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and type are a report: errors fail, some without a layer."""
    line = F.when(F.col("event_type") != "error", "  ✓ [L1] fine").when(F.col("event_id") % 7 == 0, "  ✗ no layer").otherwise(F.concat(F.lit("  ✗ [L"), (F.col("event_id") % 5).cast("string"), F.lit("/c] bad")))
    per = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("report"))
    return per.select("user_id", checks.fail_digest(F.col("report")).alias("d")).select("user_id", "d.n", "d.digest")


A19 = """WITH l AS (SELECT user_id, CASE WHEN event_id % 7 > 0 THEN 'L' || event_id % 5 END AS layer FROM events WHERE event_type = 'error'), g AS (SELECT user_id, layer, count(*) AS n FROM l GROUP BY 1, 2)
SELECT user_id, CAST(coalesce(sum(n), 0) AS INT) AS n, coalesce(string_agg(layer || '×' || n, '、' ORDER BY layer), '') AS digest FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN g USING (user_id) GROUP BY 1"""

QUERIES = {
    "t20_text_quality": (t20_text_quality, T20), "t21_flat_hits": (t21_flat_hits, T21), "t23_check_questions": (t23_check_questions, T23), "a16_audit": (a16_audit, A16), "t57_names_in": (t57_names_in, T57), "t58_spec_faults": (t58_spec_faults, T58), "e7_scene_faults": (e7_scene_faults, E7),
    "e5_dirty_tokens": (e5_dirty_tokens, E5), "e1_assertions": (e1_assertions, E1), "a18_readouts": (a18_readouts, A18), "a19_fail_digest": (a19_fail_digest, A19),
}
