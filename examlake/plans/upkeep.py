"""Queries of assertions by case, referential deletes, publishing, united tables, sessions, vocabularies and reading material, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import material
from ..functions import text as T
from ..functions.unicode import normal_form
from ..operators import assertions, merge, publishing, referential, state, vocabulary
from ..sources.tables import ANSWERS_SQL, answers, table

def _columns(sql: str) -> list[str]:
    """The columns of a list of SQL expressions, each of which ends in a name."""
    out, open_ = [], ""
    for part in sql.split(", "):
        open_ = f"{open_}, {part}" if open_ else part
        if " AS " in open_.rsplit(")", 1)[-1] and open_.count("(") == open_.count(")"):
            out, open_ = [*out, open_.strip()], ""
    return out


#: id, expression, report; asked of the cases whose number and place in this list differ by no multiple of three
ASKED = [
    ("rising", "all(diff(t) > 0)", None), ("bounded", "max(v) < limit", "max(v)"), ("middle", "mean(v) > 10", "mean(v)"), ("unknown", "w > 0", "v"), ("broken", "v >", None),
    ("total", "sum(clip(v, 0, 50)) > 9 * pi", "sum(v)"), ("ends", "v[0] <= v[-1]", "v[:2]"), ("odd", "v[0] > 1e9", "w"), ("absent", "v > 0", None), ("finite", "all(isfinite(v))", None),
]


def _specs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Kinds of events are specifications, users their cases; every third assertion is left out, and one names a case that is not there."""
    events = table(spark, d, "events").select(F.col("event_type").alias("spec"), F.col("user_id").alias("case"), F.col("event_id").alias("at"), "value")
    listed = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("id"), F.lit(e).alias("expression"), F.lit(r).cast("string").alias("report")) for i, (n, e, r) in enumerate(ASKED)])
    each = events.select("spec", "case").distinct().withColumn("a", F.explode(listed)).where((F.col("case") + F.col("a.k")) % 3 > 0)
    case = F.when(F.col("a.id") == "absent", F.col("case") + 1000000).otherwise(F.col("case"))
    asked = each.select("spec", case.alias("case"), "a.id", "a.expression", "a.report", F.create_map(F.lit("limit"), F.lit(60.0)).alias("constants"))
    samples = events.select("spec", "case", "at", F.explode(F.create_map(F.lit("t"), F.col("at").cast("double"), F.lit("v"), F.col("value"))).alias("name", "value"))
    return asked, samples


_CASES = f"""s AS (SELECT event_type AS spec, user_id AS c, event_id, value AS v FROM events),
g AS (SELECT spec, c, max(v) AS top, avg(v) AS middle, sum(least(greatest(v, 0), 50)) AS clipped, sum(v) AS total, arg_min(v, event_id) AS a, arg_max(v, event_id) AS z, least(count(*), 2) AS two FROM s GROUP BY 1, 2),
k AS (SELECT spec, c, unnest(range(0, {len(ASKED)})) AS k, unnest([{", ".join(f"'{n}'" for n, *_ in ASKED)}]) AS id, top, middle, clipped, total, a, z, two FROM g),
o AS (SELECT *, CASE id WHEN 'rising' THEN 'true' WHEN 'bounded' THEN CAST(top < 60 AS VARCHAR) WHEN 'middle' THEN CAST(middle > 10 AS VARCHAR) WHEN 'unknown' THEN 'unknown name' WHEN 'broken' THEN 'error' WHEN 'total' THEN CAST(clipped > 9 * pi() AS VARCHAR)
 WHEN 'ends' THEN CAST(a <= z AS VARCHAR) WHEN 'odd' THEN 'false' WHEN 'absent' THEN 'missing' ELSE 'true' END AS outcome FROM k WHERE (c + k) % 3 > 0)"""


def e2_spec_check(spark: SparkSession, d: str) -> DataFrame:
    return assertions.check(*_specs(spark, d)).select("spec", F.col("case").alias("c"), "id", "outcome", "name", F.try_element_at("found", F.lit(1)).alias("found"), F.size("found").alias("n_found"))


E2 = f"""WITH {_CASES} SELECT spec, CASE WHEN id = 'absent' THEN c + 1000000 ELSE c END AS c, id, outcome, CASE WHEN id = 'unknown' THEN 'w' END AS name,
 CASE WHEN outcome = 'false' THEN CASE id WHEN 'bounded' THEN round(top, 4) WHEN 'middle' THEN round(middle, 4) WHEN 'total' THEN round(total, 4) WHEN 'ends' THEN round(a, 4) END END AS found,
 CAST(CASE WHEN outcome <> 'false' OR id = 'rising' THEN NULL WHEN id = 'ends' THEN two WHEN id = 'odd' THEN 0 ELSE 1 END AS INT) AS n_found FROM o"""


def e1_gate(spark: SparkSession, d: str) -> DataFrame:
    """Another specification for each kind has no samples at all."""
    asked, samples = _specs(spark, d)
    ghosts = asked.withColumn("spec", F.concat(F.lit("no "), F.col("spec")))
    return assertions.gate(asked.unionByName(ghosts), samples).groupBy("spec", "id", "outcome").agg(F.count("*").alias("n"), F.sum(F.when(F.col("id") == "bounded", F.element_at("found", 1))).alias("found"))


E1G = f"""WITH {_CASES}, e AS (SELECT spec, id, replace(outcome, 'unknown name', 'error') AS outcome, CASE WHEN id = 'bounded' AND outcome = 'false' THEN round(top, 4) END AS f FROM o UNION ALL SELECT DISTINCT 'no ' || spec, NULL, 'no series', CAST(NULL AS DOUBLE) FROM o)
SELECT spec, id, outcome, count(*) AS n, sum(f) AS found FROM e GROUP BY 1, 2, 3"""


def _exam(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers are papers, orders their questions, lines the answers to them, urgent orders' numbers to be dropped, with some that are not there."""
    orders = table(spark, d, "orders")
    questions = orders.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("points"), "o_orderpriority")
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.lit(-1).cast("long").alias("n_questions"), F.lit(None).cast("timestamp").alias("updated_at"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    given = lines.select(F.col("o_custkey").alias("paper_id"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_orderkey")).alias("question"), F.col("l_linenumber").alias("line"), "l_quantity")
    urgent = questions.where("o_orderpriority = '1-URGENT'")
    doomed = urgent.select("paper_id", "n").union(urgent.select(F.col("paper_id") + 1, "n")).union(urgent.select("paper_id", "n"))
    return papers, questions, given, doomed


_EXAM = """q AS (SELECT o_custkey AS paper_id, o_orderkey AS n, o_totalprice AS points, o_orderpriority = '1-URGENT' AS doomed FROM orders),
a AS (SELECT paper_id, CASE WHEN l_linenumber % 5 > 0 THEN n END AS question, doomed AND l_linenumber % 5 > 0 AS lost FROM lineitem JOIN q ON n = l_orderkey),
named AS (SELECT paper_id FROM q WHERE doomed UNION SELECT paper_id + 1 FROM q WHERE doomed), p AS (SELECT c_custkey AS paper_id, c_custkey IN (SELECT paper_id FROM named) AS named FROM customer)"""


def j8_bound(spark: SparkSession, d: str) -> DataFrame:
    """How many answers hang on the numbers to be dropped, before anything is."""
    _, _, given, doomed = _exam(spark, d)
    return referential.dependants(given, ["paper_id", "question"], doomed, ["paper_id", "n"]).groupBy("paper_id").agg(F.count("*").alias("n_bound"))


J8 = f"WITH {_EXAM} SELECT paper_id, count(*) AS n_bound FROM a WHERE lost GROUP BY 1"


def _dropped(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    papers, questions, given, doomed = _exam(spark, d)
    solutions = questions.where("points > 150000").select("paper_id", "n", "points")
    return referential.drop_questions(papers, questions, given, doomed, F.lit("2000-01-01").cast("timestamp"), {"solutions": solutions})


def j9_report(spark: SparkSession, d: str) -> DataFrame:
    return _dropped(spark, d)[1]


J9R = f"WITH {_EXAM} SELECT p.paper_id, (SELECT count(*) FROM q WHERE q.paper_id = p.paper_id AND doomed) AS questions, (SELECT count(*) FROM a WHERE a.paper_id = p.paper_id AND lost) AS unbound_answers FROM p WHERE named"


def j9_after(spark: SparkSession, d: str) -> DataFrame:
    """The tables after the delete, by paper: answers are all there, bound or not."""
    after, _ = _dropped(spark, d)
    count = lambda name, **n: after[name].groupBy("paper_id").agg(*[c.alias(k) for k, c in n.items()])
    parts = [count("questions", left=F.count("*")), count("answers", answers=F.count("*"), bound=F.count("question")), count("solutions", solutions=F.count("*"))]
    out = after["papers"].select("paper_id", "n_questions", F.col("updated_at").isNotNull().alias("stamped"))
    for p in parts:
        out = out.join(p, "paper_id", "left")
    return out.na.fill(0, ["left", "answers", "bound", "solutions"])


J9A = f"""WITH {_EXAM} SELECT paper_id, CASE WHEN named THEN (SELECT count(*) FROM q WHERE q.paper_id = p.paper_id AND NOT doomed) ELSE -1 END AS n_questions, named AS stamped,
 (SELECT count(*) FROM q WHERE q.paper_id = p.paper_id AND NOT doomed) AS "left", (SELECT count(*) FROM a WHERE a.paper_id = p.paper_id) AS answers, (SELECT count(*) FROM a WHERE a.paper_id = p.paper_id AND question IS NOT NULL AND NOT lost) AS bound,
 (SELECT count(*) FROM q WHERE q.paper_id = p.paper_id AND NOT doomed AND points > 150000) AS solutions FROM p"""


def _published(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every third customer is published again: four of five of its orders, one of four of which is new, with other content, options and images."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    name, n = F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("n")
    before, now = orders.where("o_orderkey % 4 < 3"), orders.where("o_custkey % 3 = 0 AND o_orderkey % 5 > 0")
    options = lambda rows, more: lines.join(rows.select(F.col("o_orderkey").alias("l_orderkey"), name), "l_orderkey").select("name", F.col("l_orderkey").alias("n"), (F.col("l_quantity") + more).alias("okey"))
    images = lambda rows, sha: rows.select(name, F.concat(F.lit("img/"), (F.col("o_orderkey") % 7).cast("string")).alias("rel_path")).distinct().withColumn("sha256", F.lit(sha))
    stamp = lambda c, v: F.lit(v).cast("timestamp").alias(c)
    held = table(spark, d, "customer").where("c_custkey % 2 = 0")
    owner = F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey"))
    old = {
        "papers": held.select(F.col("c_custkey").alias("name"), F.lit("pdf").alias("source_kind"), F.lit("old.pdf").alias("source"), F.lit(-1).cast("long").alias("n_questions"), owner.alias("owner_id"), stamp("created_at", "1990-01-01"), stamp("updated_at", "1990-01-02"), stamp("run_started_at", "1990-01-03")),
        "questions": before.select(name, n, F.col("o_totalprice").alias("stem"), F.col("o_orderpriority").alias("label")),
        "options": options(before, 0),
        "solutions": before.where("o_totalprice > 100000").select(name, n, F.col("o_orderstatus").alias("answer")),
        "assets": images(before, "old"),
    }
    new = {
        "papers": table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("name"), F.lit("new.pdf").alias("source")),
        "questions": now.select(name, n, (F.col("o_totalprice") * 2).alias("stem")),
        "options": options(now, 100),
        "assets": images(now.where("o_orderkey % 2 = 0"), "new"),
    }
    return publishing.next_state(old, new, ["stem"], F.lit("2000-01-01").cast("timestamp"), F.lit(99).cast(dict(old["papers"].dtypes)["owner_id"]), ["options"], ["solutions"])


_PUBLISHED = """b AS (SELECT o_custkey AS name, o_orderkey AS n, o_totalprice AS price, o_orderpriority AS label FROM orders WHERE o_orderkey % 4 < 3), w AS (SELECT o_custkey AS name, o_orderkey AS n, o_totalprice AS price FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 5 > 0),
q AS (SELECT name, n, price AS stem, label FROM b WHERE name % 3 > 0 UNION ALL SELECT w.name, w.n, w.price * 2, b.label FROM w LEFT JOIN b USING (n))"""


def s8_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions after a publish: content anew, what was learned kept."""
    return _published(spark, d)["questions"]


S8Q = f"WITH {_PUBLISHED} SELECT * FROM q"


def s8_publish(spark: SparkSession, d: str) -> DataFrame:
    """Papers after a publish, with how many options, solutions and images each has, and how many of the new ones."""
    after = _published(spark, d)
    count = lambda table_, **n: after[table_].groupBy("name").agg(*[c.alias(k) for k, c in n.items()])
    parts = [count("options", n_options=F.count("*"), n_new=F.count_if(F.col("okey") > 100)), count("solutions", n_solutions=F.count("*")), count("assets", n_assets=F.count("*"), n_new_assets=F.count_if(F.col("sha256") == "new"))]
    out = after["papers"].select("name", "source_kind", "source", "n_questions", "owner_id", *[F.year(c).alias(c) for c in ("created_at", "updated_at", "run_started_at")])
    for p in parts:
        out = out.join(p, "name", "left")
    return out.na.fill(0, ["n_options", "n_new", "n_solutions", "n_assets", "n_new_assets"])


S8P = f"""WITH {_PUBLISHED}, o AS (SELECT name, l_quantity AS k FROM lineitem JOIN b ON n = l_orderkey WHERE name % 3 > 0 UNION ALL SELECT name, l_quantity + 100 FROM lineitem JOIN w ON n = l_orderkey),
s AS (SELECT b.name FROM b WHERE price > 100000 AND EXISTS (SELECT 1 FROM q WHERE q.name = b.name AND q.n = b.n)),
f AS (SELECT DISTINCT name, n % 7 AS i, true AS fresh FROM w WHERE n % 2 = 0), a AS (SELECT * FROM f UNION ALL SELECT DISTINCT name, n % 7, false FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.name = b.name AND f.i = b.n % 7)),
p AS (SELECT c_custkey AS name, c_custkey % 2 = 0 AS held, c_custkey % 3 = 0 AS fresh, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS owner FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT name, 'pdf' AS source_kind, CASE WHEN fresh THEN 'new.pdf' ELSE 'old.pdf' END AS source, CASE WHEN fresh THEN (SELECT count(*) FROM w WHERE w.name = p.name) ELSE -1 END AS n_questions, CASE WHEN fresh THEN coalesce(owner, 99) ELSE owner END AS owner_id,
 CASE WHEN held THEN 1990 ELSE 2000 END AS created_at, CASE WHEN fresh THEN 2000 ELSE 1990 END AS updated_at, CASE WHEN fresh THEN 2000 ELSE 1990 END AS run_started_at,
 (SELECT count(*) FROM o WHERE o.name = p.name) AS n_options, (SELECT count(*) FROM o WHERE o.name = p.name AND k > 100) AS n_new, (SELECT count(*) FROM s WHERE s.name = p.name) AS n_solutions, (SELECT count(*) FROM a WHERE a.name = p.name) AS n_assets, (SELECT count(*) FROM a WHERE a.name = p.name AND a.fresh) AS n_new_assets FROM p"""


def m30_united(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order are tables; every second and third of four continues the first, with rows that are as wide or not."""
    a = answers(spark, d)
    root = F.when(F.col("n") % 4 > 1, F.col("n") - F.col("n") % 4 + 1)
    row = lambda i: F.transform(F.sequence(F.lit(1), F.lit(1) + (F.col("part_id") % 2).cast("int")), lambda k: F.concat(F.col("part_id").cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), k.cast("string")))
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("part_id") % 4), row)
    tables = a.select("sheet_id", F.col("n").alias("id"), root.alias("cont_of"), F.col("n").alias("ord"), F.concat(F.lit("table "), F.col("n").cast("string")).alias("caption"), F.when(F.col("part_id") % 3 > 0, F.concat(F.lit("t"), F.col("n").cast("string"))).alias("image"), rows.alias("rows"))
    return merge.united_tables(tables, "sheet_id").select("sheet_id", "id", "caption", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|").alias("rows"), F.array_join("images", ",").alias("images"), "n_parts")


M30 = f"""WITH {ANSWERS_SQL}, t AS (SELECT sheet_id, n, part_id, CASE WHEN n % 4 > 1 THEN n - n % 4 + 1 END AS root, least(part_id % 4, 3) AS high, part_id % 2 AS wide FROM answers),
j AS (SELECT t.*, CASE WHEN r.high > 0 AND t.high > 0 AND r.wide = t.wide THEN t.root ELSE t.n END AS id FROM t LEFT JOIN t r ON r.sheet_id = t.sheet_id AND r.n = t.root),
x AS (SELECT sheet_id, id, n, part_id, array_to_string(list_transform(range(0, high), lambda i: array_to_string(list_transform(range(1, 2 + wide), lambda k: part_id || ':' || i || ':' || k), ' ')), '|') AS r FROM j)
SELECT sheet_id, CAST(x.id AS INT) AS id, 'table ' || x.id AS caption, coalesce(string_agg(r, '|' ORDER BY n) FILTER (r <> ''), '') AS rows, coalesce(string_agg('t' || n, ',' ORDER BY n) FILTER (part_id % 3 > 0), '') AS images, CAST(count(*) AS INT) AS n_parts FROM x GROUP BY sheet_id, x.id"""


def _sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    token = lambda c: F.md5(c.cast("string"))
    sessions = orders.select(token(F.col("o_orderkey")).alias("token"), F.col("o_custkey").alias("user_id"), F.dateadd(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).cast("timestamp").alias("expires_at"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    asked = orders.where("o_orderkey % 3 = 0").select(token(F.col("o_orderkey")).alias("token")).union(orders.where("o_orderkey % 5 = 0").select(token(-1 - F.col("o_orderkey")))).union(orders.limit(1).select(F.lit(None).cast("string")))
    users = table(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user_id"))
    return state.session_users(asked, sessions, users, F.lit("1996-06-01").cast("timestamp"))


_SESSIONS = """s AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS token, o_custkey AS user_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS expires, o_orderkey % 3 = 0 AS asked, o_custkey % 10 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS known FROM orders)"""


def st4_session_users(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)[0]


ST4 = f"""WITH {_SESSIONS}, t AS (SELECT token, CASE WHEN NOT known THEN 'unknown' WHEN expires < DATE '1996-06-01' THEN 'expired' ELSE 'live' END AS outcome, user_id FROM s WHERE asked UNION ALL SELECT md5(CAST(-1 - o_orderkey AS VARCHAR)), 'unknown', NULL FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT NULL, 'unknown', NULL)
SELECT token, outcome, CASE WHEN outcome = 'live' THEN user_id END AS user_id FROM t"""


def st4_sessions_after(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are left, by user, and those of them that were touched."""
    return _sessions(spark, d)[1].groupBy("user_id").agg(F.count("*").alias("n"), F.count("last_seen_at").alias("n_touched"))


ST4A = f"WITH {_SESSIONS} SELECT user_id, count(*) AS n, count(*) FILTER (asked AND known) AS n_touched FROM s WHERE NOT (asked AND known AND expires < DATE '1996-06-01') GROUP BY 1"

_LINE = "CASE event_id % 6 WHEN 0 THEN '共 ' || event_id % 30 || ' 页' WHEN 1 THEN '第 ' || event_id % 47 || ' 页 读到 3 题' WHEN 2 THEN '第' || event_id % 53 || '页 ✗ failed' WHEN 3 THEN '第 ' || event_id || ' 页' WHEN 4 THEN '共' || event_id % 20 || '页，第 ' || event_id % 19 || ' 页读到' ELSE event_type END"


def t61_read_progress(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of a user: totals, pages read and failed, and lines that say neither."""
    lines = table(spark, d, "events").select("user_id", "event_id", F.expr(_LINE).alias("line"))
    return state.read_progress(lines, "user_id", "event_id", T.page_progress(F.col("line")))


T61 = f"""WITH l AS (SELECT user_id, event_id, {_LINE} AS line FROM events), r AS (SELECT user_id, event_id, TRY_CAST(regexp_extract(line, '第\\s*(\\d+)\\s*页\\s*(?:读到|✗)', 1) AS INT) AS done, TRY_CAST(regexp_extract(line, '共\\s*(\\d+)\\s*页', 1) AS INT) AS total FROM l)
SELECT user_id, max(done) AS done, arg_max(total, event_id) AS total FROM r GROUP BY 1"""

_ENTRY = """p_partkey AS p_partkey, CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN p_brand ELSE lower(replace(p_brand, '#', '_')) || '.' || p_partkey % 97 END AS code, CASE p_size % 5 WHEN 0 THEN '磁场' WHEN 1 THEN '光学' WHEN 2 THEN p_type WHEN 3 THEN ' ' ELSE '热学' END AS chapter,
 CASE WHEN p_partkey % 13 > 0 THEN p_name END AS name, CASE p_partkey % 7 WHEN 0 THEN '["a", "b"]' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '[]' WHEN 3 THEN '5' WHEN 4 THEN 'null' WHEN 5 THEN '["x"]' END AS aliases"""


def t50_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of a vocabulary, with each kind of fault."""
    return vocabulary.problems(table(spark, d, "part").selectExpr(*_columns(_ENTRY.replace("\n", " "))), "p_partkey")


T50 = f"""WITH e AS (SELECT {_ENTRY} FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS k FROM e)
SELECT p_partkey, 'lacks' AS problem, unnest(list_filter([CASE WHEN trim(coalesce(code, '')) = '' THEN 'code' END, CASE WHEN trim(coalesce(chapter, '')) = '' THEN 'chapter' END, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END], lambda x: x IS NOT NULL)) AS detail FROM n
UNION ALL SELECT p_partkey, 'repeated', code FROM n WHERE k > 1 UNION ALL SELECT p_partkey, 'code', code FROM n WHERE code <> '' AND NOT regexp_full_match(code, '[a-z0-9_.]+') UNION ALL SELECT p_partkey, 'chapter', chapter FROM n WHERE chapter NOT IN ('{"', '".join(vocabulary.CHAPTERS)}')
UNION ALL SELECT p_partkey, 'aliases', aliases FROM n WHERE aliases IS NOT NULL AND json_type(aliases) <> 'ARRAY'"""


#: what is known about a document taken for a question
_KNOWN = """doc_id AS n, CASE WHEN doc_id % 5 > 0 THEN lang END AS kind, CASE doc_id % 4 WHEN 0 THEN concat(' $x$ ', substr(text, 1, 290), ' ') WHEN 1 THEN '' END AS stem_latex, CASE WHEN doc_id % 6 > 0 THEN text END AS stem, doc_id % 3 = 0 AS sheet,
 CASE WHEN doc_id % 2 = 0 THEN concat(' ', substr(text, 5, 230)) END AS ref_answer, CASE WHEN doc_id % 7 < 3 THEN concat(source, ' ', text) END AS ref_solution, CASE WHEN doc_id % 8 < 5 THEN substr(text, 9, 280) ELSE '' END AS answer, substr(text, 1, 150) AS s1, substr(text, 100, 400) AS s2, doc_id % 5 AS steps"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    fields = _KNOWN.replace("\n", " ")
    docs = table(spark, d, "documents").selectExpr("*", *_columns(fields))
    return docs.withColumn("steps", F.when(F.col("steps") == 0, F.array().cast("array<string>")).when(F.col("steps") == 1, F.array("s1")).when(F.col("steps") < 4, F.array("s1", "s2")))


def _md5(df: DataFrame, text) -> DataFrame:
    return df.select(F.col("n").alias("doc_id"), F.md5(text).alias("material_md5"))


_FOLD = "regexp_replace({}, '\\s+', ' ', 'g')"
_STEM = "coalesce(nullif(stem_latex, ''), stem, '')"
_TRIM = "regexp_replace(coalesce({}, ''), '^\\s+|\\s+$', '', 'g')"
_STEPS = "CASE WHEN steps = 0 OR steps = 4 THEN '' WHEN steps = 1 THEN s1 ELSE s1 || '{}' || s2 END"
_HEAD = "'【第' || n || '题】' || coalesce(kind, '')"
_fold = lambda c, n: f"left({_FOLD.format(c)}, {n})"


def t66_topics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _md5(_known(spark, d), material.for_topics(c("sheet"), c("n"), c("kind"), c("stem_latex"), c("stem"), c("ref_answer"), c("ref_solution"), c("steps"), c("answer")))


T66 = f"""WITH k AS (SELECT {_KNOWN} FROM documents), p AS (SELECT n, sheet, {_HEAD} AS head, {_fold(_TRIM.format(_STEM), 260)} AS stem, {_fold(_TRIM.format("ref_answer"), 200)} AS ref, {_fold(_TRIM.format("ref_solution"), 400)} AS sol, {_fold(_STEPS.format(" "), 400)} AS steps, {_fold("answer", 200)} AS answer FROM k)
SELECT n AS doc_id, md5(CASE WHEN sheet THEN concat_ws(chr(10), head, CASE WHEN stem <> '' THEN '题干：' || stem END, CASE WHEN ref <> '' THEN '标准答案：' || ref END, CASE WHEN sol <> '' THEN '官方解答：' || sol END, CASE WHEN stem || ref || sol = '' THEN '（这道题只有题号，没有任何可判断的材料）' END)
 ELSE concat_ws(chr(10), head, '题干：' || stem, CASE WHEN steps <> '' THEN '解法：' || steps WHEN answer <> '' THEN '答案：' || answer ELSE '解法：（尚未解出，只能看题干判断）' END) END) AS material_md5 FROM p"""


def t67_outline(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _md5(_known(spark, d), material.for_outline(c("n"), c("kind"), c("stem_latex"), c("stem"), c("answer")))


T67 = f"WITH k AS (SELECT {_KNOWN} FROM documents) SELECT n AS doc_id, md5(concat_ws(chr(10), {_HEAD}, '题干：' || {_fold(_TRIM.format(_STEM), 220)}, CASE WHEN answer <> '' THEN '答案：' || {_fold('answer', 260)} ELSE '答案：（尚未解出）' END)) AS material_md5 FROM k"


def t68_pick(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _md5(_known(spark, d), material.for_pick(c("n"), c("kind"), c("stem_latex"), c("stem"), c("answer"), c("steps")))


T68 = f"WITH k AS (SELECT {_KNOWN} FROM documents) SELECT n AS doc_id, md5(concat_ws(chr(10), {_HEAD}, '题干：' || {_fold(_STEM, 300)}, CASE WHEN answer <> '' THEN '答案：' || {_fold('answer', 200)} END, CASE WHEN {_STEPS.format('')} <> '' THEN '解法：' || {_fold(_STEPS.format(' / '), 260)} END)) AS material_md5 FROM k"


def t69_advice(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an order that lost points, put together in order."""
    a = answers(spark, d).where("verdict <> 'right'")
    c = F.col
    number = F.when(c("n") % 2 == 0, c("n") * 100 + c("part_id") % 7).otherwise(c("n"))
    topics = F.when(c("part_id") % 3 == 0, F.array(F.lit("磁场"), F.lit(None), F.lit("光学"))).when(c("part_id") % 3 == 1, F.array().cast("array<string>"))
    text = material.for_advice(number, c("verdict"), c("score_got").cast("string"), F.when(c("part_id") % 5 > 0, c("score_full").cast("string")), c("part_id"), F.when(c("part_id") % 2 == 0, c("part_id") + 1), topics, F.when(c("part_id") % 4 == 0, F.repeat(F.lit("step "), (c("part_id") % 200).cast("int"))))
    return material.together(a.select("sheet_id", "n", text.alias("text")), "sheet_id", "n", "text").select("sheet_id", F.md5("material").alias("material_md5"))


T69 = f"""WITH {ANSWERS_SQL}, t AS (SELECT sheet_id, n, CASE WHEN n % 2 = 0 THEN '第 ' || n || '(' || part_id % 7 || ') 题' ELSE '第 ' || n || ' 题' END || CASE WHEN verdict = 'partial' THEN '（**半对**，得 ' || score_got || ' 分、满分 ' || CASE WHEN part_id % 5 > 0 THEN CAST(score_full AS VARCHAR) ELSE 'None' END || ' 分）' ELSE '' END
 || chr(10) || '  学生写的：' || part_id || chr(10) || '  标准答案：' || CASE WHEN part_id % 2 = 0 THEN CAST(part_id + 1 AS VARCHAR) ELSE 'None' END || CASE WHEN part_id % 3 = 0 THEN chr(10) || '  这道题考的：磁场、光学' ELSE '' END || CASE WHEN part_id % 4 = 0 AND part_id % 200 > 0 THEN chr(10) || '  官方解答：' || left(repeat('step ', CAST(part_id % 200 AS INT)), 600) ELSE '' END AS text
 FROM answers WHERE verdict <> 'right') SELECT sheet_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY n)) AS material_md5 FROM t GROUP BY 1"""


def t70_spec(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    k = _known(spark, d)
    tables = F.when(c("n") % 4 == 0, F.array(F.struct(F.lit(1).alias("id"), F.array(F.array("lang", "source"), F.array("source", "lang")).alias("rows")), F.struct(F.lit(2).alias("id"), F.array().cast("array<array<string>>").alias("rows")), F.struct(F.lit(3).alias("id"), F.array(F.array("lang")).alias("rows"))))
    options = F.when(c("n") % 3 == 0, F.array(F.struct(F.lit("A").alias("key"), F.lit("").alias("latex"), c("lang").alias("text")), F.struct(F.lit("B").alias("key"), F.lit("$y$").alias("latex"), c("lang").alias("text"))))
    return _md5(k, material.for_spec(c("n"), c("kind"), c("stem_latex"), c("stem"), tables, options, c("answer"), c("steps"), F.array("lang"), F.when(c("n") % 2 == 0, F.array("source", "lang")), F.when(c("n") % 9 > 0, c("source"))))


T70 = f"""WITH k AS (SELECT {_KNOWN}, lang, source FROM documents) SELECT n AS doc_id, md5(concat_ws(chr(10) || chr(10), '【题号】' || n, '【题型】' || coalesce(kind, ''), '【题干】' || chr(10) || {_STEM}, CASE WHEN n % 4 = 0 THEN '【表1】' || chr(10) || lang || ' | ' || source || chr(10) || source || ' | ' || lang || chr(10) || chr(10) || '【表3】' || chr(10) || lang END,
 CASE WHEN n % 3 = 0 THEN '【选项】' || chr(10) || 'A. ' || lang || chr(10) || 'B. $y$' END, '【阶段③ 给出的答案】' || chr(10) || answer, '【解题步骤】' || chr(10) || CASE WHEN steps IN (0, 4) THEN '' WHEN steps = 1 THEN '- ' || s1 ELSE '- ' || s1 || chr(10) || '- ' || s2 END, '【可检验事实】（断言应当钉住这些）' || chr(10) || '- ' || lang,
 CASE WHEN n % 2 = 0 THEN '【解题时自补的假设】（题面没给，断言若依赖它们必须在 free_parameters 里说明）' || chr(10) || '- ' || source || chr(10) || '- ' || lang END, '【解题置信度】' || CASE WHEN n % 9 > 0 THEN source ELSE '?' END)) AS material_md5 FROM k"""

#: letters that are put together with the mark after them, and one that is not
_MARKED = "translate(text, 'nq', '̣́')"


def t3_composed(spark: SparkSession, d: str) -> DataFrame:
    """Texts with two letters made marks above and below, so that these stand in either order, in the form NFC."""
    return table(spark, d, "documents").select("doc_id", F.md5(normal_form(F.expr(_MARKED), "NFC")).alias("text_md5"))


T3C = f"SELECT doc_id, md5(nfc_normalize({_MARKED})) AS text_md5 FROM documents"

QUERIES = {
    "e2_spec_check": (e2_spec_check, E2), "e1_gate": (e1_gate, E1G), "j8_bound": (j8_bound, J8), "j9_report": (j9_report, J9R), "j9_after": (j9_after, J9A), "s8_questions": (s8_questions, S8Q), "s8_publish": (s8_publish, S8P), "m30_united": (m30_united, M30), "st4_session_users": (st4_session_users, ST4), "st4_sessions_after": (st4_sessions_after, ST4A),
    "t61_read_progress": (t61_read_progress, T61), "t50_vocabulary": (t50_vocabulary, T50), "t66_topics": (t66_topics, T66), "t67_outline": (t67_outline, T67), "t68_pick": (t68_pick, T68), "t69_advice": (t69_advice, T69), "t70_spec": (t70_spec, T70), "t3_composed": (t3_composed, T3C),
}
