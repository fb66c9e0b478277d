"""Queries of windows, state and merges over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import merge, state, windows
from ..sources.tables import ANSWERS_SQL, PAPERS_SQL, SHEETS_SQL, answers, papers, sheets, table

HALF_DAY = 43200


def w1_number_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), "l_shipdate", "l_partkey", "l_linenumber")
    return windows.number_chain(rows, "sheet_id", ["l_shipdate", "l_partkey", "l_linenumber"], "l_linenumber")


W1 = """WITH o AS (SELECT l_orderkey AS sheet_id, l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS k FROM lineitem),
r AS (WITH RECURSIVE f AS (SELECT sheet_id, 0 AS k, 0 AS c FROM (SELECT DISTINCT sheet_id FROM o) UNION ALL SELECT o.sheet_id, o.k, CASE WHEN o.x = f.c + 1 THEN o.x ELSE f.c END FROM f JOIN o ON o.sheet_id = f.sheet_id AND o.k = f.k + 1) SELECT sheet_id, max(c) AS c FROM f GROUP BY 1)
SELECT sheet_id, CAST(c AS BIGINT) AS chain, c >= 4 AS accepted FROM r"""


def w3_separators(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("double").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + 10).alias("x1"), F.lit(12.0).alias("size"))
    return windows.separators(runs, "page", ["l_linenumber", "l_partkey", "l_suppkey", "x"], "y", "x", "x1", "size").select("page", "l_linenumber", "l_partkey", "x", "separator")


W3 = """SELECT l_orderkey AS page, l_linenumber, l_partkey, l_quantity AS x, CASE WHEN abs(l_linenumber - lag(l_linenumber) OVER w) > 7.2 OR l_quantity - lag(l_quantity + 10) OVER w > 3.6 THEN ' ' ELSE '' END AS separator
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"""


def w5_rows_by_top(spark: SparkSession, d: str) -> DataFrame:
    return windows.rows_by_top(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 20.0)


W5 = """WITH RECURSIVE o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, x AS anchor, 1 AS r FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN abs(o.x - f.anchor) <= 20 THEN f.anchor ELSE o.x END, CASE WHEN abs(o.x - f.anchor) <= 20 THEN f.r ELSE f.r + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
g AS (SELECT user_id, r, count(*) AS n FROM f GROUP BY 1, 2)
SELECT user_id, CAST(count(*) AS INT) AS n_rows, string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS sizes FROM g GROUP BY 1"""


def w8_flow_offsets(spark: SparkSession, d: str) -> DataFrame:
    return windows.flow_offsets(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "text").select("conv_id", "turn", "role", "offset")


W8 = "SELECT conv_id, turn, role, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations"


def w9_islands(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


W9 = """WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY 1, 2"""


def w10_strips(spark: SparkSession, d: str) -> DataFrame:
    """Lines are marks whose place is their quantity, a few out of range; a strip is told as its numbers, top and bottom."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_quantity") - 2) / 47).alias("y"))
    cut = windows.strips(rows, "sheet_id", ["l_partkey", "l_suppkey", "y"], "l_linenumber", "y", 2000)
    told = F.transform("strips", lambda x: F.concat(F.array_join(x["numbers"].cast("array<string>"), "+"), F.lit("@"), x["top"].cast("string"), F.lit("-"), x["bottom"].cast("string")))
    return cut.select("sheet_id", F.array_join(told, ";").alias("strips"), F.array_join(F.col("dropped").cast("array<string>"), "+").alias("dropped"))


W10 = """WITH RECURSIVE a AS (SELECT l_orderkey AS s, l_linenumber AS n, (l_quantity - 2) / 47 AS y, l_partkey, l_suppkey FROM lineitem),
m AS (SELECT s, n, y, row_number() OVER (PARTITION BY s ORDER BY n, l_partkey, l_suppkey, y) AS i FROM a WHERE y BETWEEN 0 AND 1),
d(s, i, b, v, ys, ns) AS (SELECT s, i, [CAST(1 AS BIGINT)], [CAST(0 AS BIGINT)], [y], [n] FROM m WHERE i = 1 UNION ALL
 SELECT s, i, list_append(b, best), list_append(v, coalesce(list_position(list_transform(range(1, i), lambda j: ys[j] < y AND b[j] = best - 1), true), 0)), list_append(ys, y), list_append(ns, n)
 FROM (SELECT d.s, m.i, d.b, d.v, d.ys, d.ns, m.y, m.n, CAST(1 + coalesce(list_max(list_transform(list_filter(range(1, m.i), lambda j: d.ys[j] < m.y), lambda j: d.b[j])), 0) AS BIGINT) AS best FROM d JOIN m ON m.s = d.s AND m.i = d.i + 1)),
e AS (SELECT * FROM d QUALIFY i = max(i) OVER (PARTITION BY s)),
k(s, tip, kept, v, ys, ns) AS (SELECT s, CAST(list_position(b, list_max(b)) AS BIGINT), [CAST(list_position(b, list_max(b)) AS BIGINT)], v, ys, ns FROM e UNION ALL SELECT s, v[tip], list_prepend(v[tip], kept), v, ys, ns FROM k WHERE v[tip] > 0),
c AS (SELECT *, len(kept) < len(ns) AND len(kept) < greatest(3, 0.6 * len(ns)) AS none FROM k QUALIFY len(kept) = max(len(kept)) OVER (PARTITION BY s)),
g(s, j, kept, ys, ns, gs) AS (SELECT s, CAST(1 AS BIGINT), kept, ys, ns, [{'f': ys[kept[1]], 'ns': [ns[kept[1]]]}] FROM c WHERE NOT none UNION ALL
 SELECT s, j + 1, kept, ys, ns, CASE WHEN (len(gs[-1].ns) >= 8 OR deep >= 260) AND deep >= 24 THEN list_append(gs, {'f': ys[kept[j + 1]], 'ns': [ns[kept[j + 1]]]}) ELSE list_append(gs[:-2], {'f': gs[-1].f, 'ns': list_append(gs[-1].ns, ns[kept[j + 1]])}) END
 FROM (SELECT *, (ys[kept[j + 1]] - gs[-1].f) * 2000 AS deep FROM g) WHERE j < len(kept)),
f AS (SELECT s, gs FROM g WHERE j = len(kept))
SELECT o.s AS sheet_id, coalesce(array_to_string(list_transform(range(1, len(gs) + 1), lambda i: array_to_string(gs[i].ns, '+') || '@' || greatest(0, CAST(trunc((gs[i].f - 0.05) * 2000) AS INT)) || '-' || CASE WHEN i < len(gs) THEN CAST(trunc(gs[i + 1].f * 2000) AS INT) ELSE 2000 END), ';'), '') AS strips,
 coalesce(array_to_string(CASE WHEN none THEN c.ns ELSE list_transform(list_filter(range(1, len(c.ns) + 1), lambda i: NOT list_contains(c.kept, i)), lambda i: c.ns[i]) END, '+'), '') AS dropped FROM (SELECT DISTINCT s FROM a) o LEFT JOIN c ON c.s = o.s LEFT JOIN f ON f.s = o.s"""


def w11_slices(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("y"))
    return windows.monotonic_slices(marks, "sheet_id", "n", "y", F.lit(100.0))


W11 = """WITH m AS (SELECT l_orderkey AS sheet_id, l_linenumber AS n, min(l_quantity) AS y FROM lineitem GROUP BY 1, 2), s AS (SELECT *, coalesce(y > lag(y) OVER w, true) AS good, coalesce(lead(y) OVER w, 100.0) AS until FROM m WINDOW w AS (PARTITION BY sheet_id ORDER BY n))
SELECT sheet_id, n, y, until FROM s QUALIFY bool_and(good) OVER (PARTITION BY sheet_id)"""


def w13_spans(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    return windows.spans_until_next(anchors, "user_id", "event_id", F.lit(10**9).cast("long"))


W13 = "SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS until FROM events WHERE event_type = 'purchase'"


def k1_pick_cap(spark: SparkSession, d: str) -> DataFrame:
    return windows.pick_capped(sheets(spark, d), "paper_id", "total", "sheet_id", F.col("status") != "P").select("paper_id", "sheet_id", "picked", "why")


K1 = f"""WITH {SHEETS_SQL}, r AS (SELECT *, status <> 'P' AS need, row_number() OVER (PARTITION BY paper_id, status <> 'P' ORDER BY total DESC NULLS LAST, sheet_id) AS k FROM sheets)
SELECT paper_id, sheet_id, need AND k <= 6 AS picked, CASE WHEN NOT need THEN 'not needed' WHEN k > 6 THEN 'over the cap' ELSE '' END AS why FROM r"""


def k2_natural_order(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("scans/P-"), (F.col("p_partkey") % 100).cast("string"), F.lit("_"), F.repeat(F.lit("1"), (F.col("p_partkey") % 20).cast("int")), F.lit("0"), F.col("p_size").cast("string"), F.lit(".PNG")).alias("name"))
    return names.withColumn("sort_key", windows.natural_key(F.col("name"))).withColumn("page", F.row_number().over(Window.partitionBy("p_brand").orderBy("sort_key", "p_partkey")))


K2 = r"""WITH n AS (SELECT p_partkey, p_brand, 'scans/P-' || p_partkey % 100 || '_' || repeat('1', p_partkey % 20) || '0' || p_size || '.PNG' AS name FROM part),
k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(substr(name, 7), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 4, '0') || ltrim(x, '0') ELSE '0000' || lower(x) END), chr(1)) AS sort_key FROM n)
SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY encode(sort_key), p_partkey) AS INT) AS page FROM k"""


def st1_quota(spark: SparkSession, d: str) -> DataFrame:
    return state.quota(table(spark, d, "events"), "user_id", F.unix_timestamp("ts"), "event_id", HALF_DAY, 2)


ST1 = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS allowed, [t] AS recent FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, len(list_filter(f.recent, lambda x: x > o.t - {HALF_DAY})) < 2,
  CASE WHEN len(list_filter(f.recent, lambda x: x > o.t - {HALF_DAY})) < 2 THEN list_append(list_filter(f.recent, lambda x: x > o.t - {HALF_DAY}), o.t) ELSE list_filter(f.recent, lambda x: x > o.t - {HALF_DAY}) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f"""


def st2_throttle(spark: SparkSession, d: str) -> DataFrame:
    return state.throttle(table(spark, d, "events"), "user_id", F.unix_timestamp("ts"), "event_id", HALF_DAY)


ST2 = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS allowed, t AS last FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, f.last <= o.t - {HALF_DAY}, CASE WHEN f.last <= o.t - {HALF_DAY} THEN o.t ELSE f.last END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f"""


def st8_last_job(spark: SparkSession, d: str) -> DataFrame:
    return state.last_job(table(spark, d, "events"), "user_id", "event_id", "event_type", ["click", "view"], ["error"])


ST8 = "SELECT user_id, max(event_id) FILTER (event_type IN ('click', 'view')) AS live_job, arg_max(event_type, event_id) = 'error' AS failed FROM events GROUP BY 1"


def st13_drift(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return state.drift(p.select("p_partkey", F.concat("p_name", F.lit("-"), "p_brand").alias("v")), p.select("p_partkey", F.concat("p_name", F.lit("-"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))).alias("v")), "p_partkey", "v")


_MASK = "CASE WHEN length({0}) >= 10 THEN left({0}, 4) || '...' || right({0}, 4) ELSE '...' END"
ST13 = f"WITH p AS (SELECT p_partkey, p_name || '-' || p_brand AS a, p_name || '-' || CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS b FROM part) SELECT p_partkey, {_MASK.format('a')} AS \"left\", {_MASK.format('b')} AS \"right\" FROM p WHERE a <> b"


def st14_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    before = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    after = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.upper("source")).otherwise(F.col("text")), 256).alias("digest"))
    return state.manifest_changes(before, after, "doc_id", "digest")


ST14 = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 7 = 0 AND upper(source) <> text)"


def m2_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return merge.snapshot(p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("label")), p.where("p_partkey % 3 = 0"), "p_partkey", ["p_name", "p_size"], ["label"])


M2 = "SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM part WHERE p_partkey % 3 = 0"


def m4_put_scene(spark: SparkSession, d: str) -> DataFrame:
    tries = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sheet_id")
    return merge.last_success(tries, "sheet_id", ["l_shipdate", "l_partkey"], F.col("l_returnflag") == "R", ["l_shipdate", "l_partkey"])


M4 = "SELECT l_orderkey AS sheet_id, l_returnflag = 'R' AS passed, l_shipdate, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_shipdate DESC, l_partkey DESC) = 1"


def m5_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return merge.insert_absent(n.where("event_type = 'click' and user_id % 2 = 0"), n.where("event_type <> 'click'"), "user_id")


M5 = "WITH o AS (SELECT user_id, event_id, event_type FROM events WHERE event_type = 'click' AND user_id % 2 = 0) SELECT * FROM o UNION ALL SELECT user_id, min(event_id), arg_min(event_type, event_id) FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM o) GROUP BY 1"


def m7_conditional(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("owner"), "p_name")
    new = p.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("owner")).alias("owner"), F.upper("p_name").alias("p_name")).where("p_partkey % 4 <> 0")
    return merge.conditional(p, new, "p_partkey", ["owner"], ["p_name"])


M7 = """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS owner, p_name FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN owner END AS owner, upper(p_name) AS p_name FROM p WHERE p_partkey % 4 <> 0)
SELECT p.p_partkey, p.owner, CASE WHEN n.p_partkey IS NOT NULL AND p.owner IS NOT DISTINCT FROM n.owner THEN n.p_name ELSE p.p_name END AS p_name, n.p_partkey IS NOT NULL AND p.owner IS NOT DISTINCT FROM n.owner AS applied FROM p LEFT JOIN n USING (p_partkey)"""


def m8_exclusive(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return merge.exclusive(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), "user_id", "event_id")


M8 = "SELECT user_id, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN 'solution' ELSE 'failure' END AS kind, max(event_id) AS event_id FROM events GROUP BY 1"


def m24_resolved(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("alias"), F.col("p_brand").alias("code"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("alias")).agg(F.min("l_linenumber").alias("n"), F.max("l_returnflag").alias("why"))
    return merge.resolved(rows, vocabulary, "l_orderkey", "n", "alias", "why").select("l_orderkey", "code", "rank")


M24 = """WITH r AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT l_orderkey, p_brand AS code, min(n) AS n FROM r JOIN part ON p_partkey = l_partkey AND p_size > 20 GROUP BY 1, 2)
SELECT l_orderkey, code, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n, code) AS INT) AS rank FROM k QUALIFY rank <= 3"""


def m26_removed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return merge.removed(p, p.where("p_size > 5"), "p_partkey", table(spark, d, "lineitem"), "l_partkey")


M26 = "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_dependants FROM part WHERE p_size <= 5"


def m27_backfill(spark: SparkSession, d: str) -> DataFrame:
    return merge.any_sibling(sheets(spark, d), "paper_id", F.col("status") == "P").select("sheet_id", "judged")


M27 = "SELECT o_orderkey AS sheet_id, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P') AS judged FROM orders a"


def m29_delete(spark: SparkSession, d: str) -> DataFrame:
    wanted = sheets(spark, d).select(F.pmod(F.col("sheet_id") * 7, F.lit(3000)).alias("paper_id"))
    return merge.owned_delete(papers(spark, d), wanted, "paper_id", F.col("owner_id") < 12)


M29 = f"WITH {PAPERS_SQL}, w AS (SELECT DISTINCT o_orderkey * 7 % 3000 AS paper_id FROM orders) SELECT paper_id, CASE WHEN owner_id IS NULL THEN 'missing' WHEN owner_id < 12 THEN 'deleted' ELSE 'refused' END AS result FROM w LEFT JOIN papers USING (paper_id)"


def m30_merged_tables(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 17).alias("width"), F.floor(F.col("l_quantity") / 3).alias("cells"))
    return merge.merged_tables(parts, "l_orderkey", "l_linenumber", "width", "cells")


M30 = "SELECT l_orderkey, count(*) AS n_parts, min(ceil(l_quantity / 17)) = max(ceil(l_quantity / 17)) AND min(floor(l_quantity / 3)) > 0 AS merged, CAST(sum(floor(l_quantity / 3)) AS BIGINT) AS cells FROM lineitem GROUP BY 1"

QUERIES = {
    "w1_number_chain": (w1_number_chain, W1), "w3_separators": (w3_separators, W3), "w5_rows_by_top": (w5_rows_by_top, W5), "w8_flow_offsets": (w8_flow_offsets, W8), "w9_islands": (w9_islands, W9),
    "w10_strips": (w10_strips, W10), "w11_slices": (w11_slices, W11), "w13_spans": (w13_spans, W13), "k1_pick_cap": (k1_pick_cap, K1), "k2_natural_order": (k2_natural_order, K2),
    "st1_quota": (st1_quota, ST1), "st2_throttle": (st2_throttle, ST2), "st8_last_job": (st8_last_job, ST8), "st13_drift": (st13_drift, ST13), "st14_manifest": (st14_manifest, ST14),
    "m2_snapshot_merge": (m2_snapshot_merge, M2), "m4_put_scene": (m4_put_scene, M4), "m5_insert_absent": (m5_insert_absent, M5),
    "m7_conditional": (m7_conditional, M7), "m8_exclusive": (m8_exclusive, M8), "m24_resolved": (m24_resolved, M24),
    "m26_removed": (m26_removed, M26), "m27_backfill": (m27_backfill, M27), "m29_delete": (m29_delete, M29), "m30_merged_tables": (m30_merged_tables, M30),
}
