"""Queries of page geometry over pages made of ``events``, with their SQL: a user's events are the runs, rules and parts of a page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from ..sources.tables import table

# a run and a bar for each event; the same expressions serve both engines
_RUN = """user_id AS page, event_id AS seq, 40e0 + event_id % 4 * 120 + event_id * 7 % 5 * 6 AS x, 58e0 + event_id % 4 * 120 + event_id * 7 % 5 * 6 + event_id * 13 % 23 AS x1,
 720e0 - floor(value / 12) * 14 - event_id % 3 * 5 AS y, 728e0 - floor(value / 12) * 14 - event_id % 3 * 5 + CASE WHEN event_id % 29 = 0 THEN 18 ELSE 0 END AS yt, CASE WHEN event_id % 6 = 0 THEN 7.5e0 ELSE 10.5e0 END AS size,
 CASE WHEN event_id % 19 = 0 THEN '√' WHEN event_id % 23 = 0 THEN 'A. x' ELSE event_type END AS text"""
_BAR = """user_id AS page, event_id AS rule, 42e0 + event_id % 4 * 120 + event_id * 7 % 5 * 6 AS x, 20e0 + event_id % 40 AS w, 714e0 - floor(value / 12) * 14 AS y"""
_RUNS = f"r AS (SELECT {_RUN} FROM events WHERE event_type <> 'purchase'), u AS (SELECT {_BAR} FROM events WHERE event_type = 'purchase')"
_BODY = "b AS (SELECT page, size AS bs FROM (SELECT page, size, count(*) AS n, min(seq) AS f FROM r WHERE size <> 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, f) = 1)"


def _page(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    runs = events.where("event_type <> 'purchase'").selectExpr(*_fields(_RUN))
    return runs, events.where("event_type = 'purchase'").selectExpr(*_fields(_BAR))


def _fields(sql: str) -> list[str]:
    """The columns of a list of SQL expressions; commas within brackets part none."""
    return re.split(r",\s+(?![^()]*\))", sql.replace("\n", " "))


def w4_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with bars, radicals, tall glyphs and wrapped columns."""
    return geometry.reading_order(*_page(spark, d), "page")


W4 = f"""WITH RECURSIVE {_RUNS}, {_BODY},
o AS (SELECT r.*, bs, regexp_matches(text, '^\\s*[ABCD]\\s*[.．、]') AS opt, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, seq) AS k FROM r JOIN b USING (page)),
c(page, k, line, head, prev) AS (SELECT page, k, 0, y, y FROM o WHERE k = 1
  UNION ALL SELECT o.page, o.k, c.line + CASE WHEN c.prev - o.y > bs * 0.9 OR c.head - o.y > bs * 1.15 THEN 1 ELSE 0 END, CASE WHEN c.prev - o.y > bs * 0.9 OR c.head - o.y > bs * 1.15 THEN o.y ELSE c.head END, o.y FROM c JOIN o ON o.page = c.page AND o.k = c.k + 1),
l AS (SELECT o.*, line FROM o JOIN c USING (page, k)),
t AS (SELECT l.page, rule, u.y AS ry, seq, least(x1, u.x + w) - greatest(l.x, u.x) >= 0.6 * greatest(1e-6, x1 - l.x) AS lies, regexp_matches(text, '^\\s*[√∛∜]\\s*$') AND u.x - x1 BETWEEN -2 AND 8 AS sign FROM l JOIN u USING (page)),
g(it, page, seq, line) AS (SELECT 0, page, seq, line FROM l UNION ALL (
  WITH n AS (SELECT * FROM g), m AS (SELECT n.page, n.seq, n.line, l.y, l.yt, l.bs FROM n JOIN l USING (page, seq)),
  a AS (SELECT page, line, min(y) AS bottom, max(y) AS head, any_value(bs) AS bs FROM m GROUP BY page, line),
  a2 AS (SELECT *, lead(line) OVER (PARTITION BY page ORDER BY line) AS lower, lead(head) OVER (PARTITION BY page ORDER BY line) AS nh FROM a),
  q AS (SELECT * FROM a2 WHERE bottom - nh <= bs * 2.6),
  z AS (SELECT t.page, rule, ry, n.line, bool_or(lies) AS lies, bool_or(sign) AS sign FROM t JOIN n USING (page, seq) WHERE lies OR sign GROUP BY 1, 2, 3, 4),
  e AS (SELECT q.page, q.lower FROM q JOIN z za ON za.page = q.page AND za.line = q.line JOIN z zb ON zb.page = q.page AND zb.line = q.lower AND zb.rule = za.rule AND zb.lies WHERE za.ry BETWEEN nh - 1 AND bottom + 1
    UNION SELECT q.page, q.lower FROM q JOIN m ON m.page = q.page AND (m.line = q.line OR m.line = q.lower) WHERE m.yt - m.y > q.bs * 1.4 AND m.yt >= bottom - 1 AND m.y <= nh + 1),
  f AS (SELECT a.page, a.line, sum(CASE WHEN e.lower IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY a.page ORDER BY a.line) AS nl FROM a LEFT JOIN e ON e.page = a.page AND e.lower = a.line)
  SELECT n.it + 1, n.page, n.seq, CAST(f.nl AS INT) FROM n JOIN f USING (page, line) WHERE n.page IN (SELECT page FROM e))),
p AS (SELECT page, seq, line FROM g QUALIFY it = max(it) OVER (PARTITION BY page)),
d AS (SELECT l.page, l.seq, x, x1, y, bs, opt, dense_rank() OVER (PARTITION BY l.page ORDER BY p.line) AS row FROM l JOIN p ON p.page = l.page AND p.seq = l.seq),
h(it, page, seq, part, bycol) AS (SELECT CAST(1 AS BIGINT), page, seq, CAST(1 AS BIGINT), false FROM d WHERE row = 1 UNION ALL (
  WITH cur AS (SELECT h.*, d.x, d.x1, d.y, d.bs FROM h JOIN d USING (page, seq)),
  gp AS (SELECT *, CASE WHEN x - lag(x1) OVER (PARTITION BY page ORDER BY x, y DESC, seq) > bs * 2.5 THEN 1 ELSE 0 END AS nc FROM cur),
  cl AS (SELECT *, sum(nc) OVER (PARTITION BY page ORDER BY x, y DESC, seq) AS col FROM gp),
  bd AS (SELECT page, col, min(x) - any_value(bs) AS lo, max(x1) + any_value(bs) AS hi FROM cl GROUP BY 1, 2),
  st AS (SELECT page, any_value(it) AS it, any_value(part) AS part, min(y) AS bottom, count(*) AS n, max(col) + 1 AS ncol, any_value(bs) AS bs FROM cl GROUP BY page),
  nx AS (SELECT d.* FROM d JOIN st ON d.page = st.page AND d.row = st.it + 1),
  ib AS (SELECT nx.page, nx.seq, bool_or(lo <= nx.x AND nx.x1 <= hi) AS fits FROM nx JOIN bd USING (page) GROUP BY 1, 2),
  ns AS (SELECT nx.page, count(*) AS n, max(y) AS head, bool_or(opt) AS opt, bool_and(fits) AS fits FROM nx JOIN ib USING (page, seq) GROUP BY 1),
  ok AS (SELECT st.page, st.it, st.part, ncol >= 2 AND ns.n < st.n AND bottom - head > 0 AND bottom - head <= bs * 1.8 AND NOT opt AND fits AS ok FROM st JOIN ns USING (page))
  SELECT ok.it + 1, cur.page, cur.seq, ok.part, true FROM cur JOIN ok USING (page) WHERE ok UNION ALL SELECT ok.it + 1, nx.page, nx.seq, ok.part + CASE WHEN ok THEN 0 ELSE 1 END, ok FROM nx JOIN ok USING (page))),
v AS (SELECT h.page, h.seq, part, bycol, x, x1, y, bs FROM h JOIN d USING (page, seq) QUALIFY it = max(it) OVER (PARTITION BY h.page, part)),
vg AS (SELECT *, CASE WHEN bycol AND x - lag(x1) OVER (PARTITION BY page, part ORDER BY x, y DESC, seq) > bs * 2.5 THEN 1 ELSE 0 END AS nc FROM v),
vc AS (SELECT *, sum(nc) OVER (PARTITION BY page, part ORDER BY x, y DESC, seq) AS col FROM vg),
vk AS (SELECT *, row_number() OVER (PARTITION BY page, part, col ORDER BY y DESC, x, seq) AS k FROM vc),
w(page, part, col, k, grp, head) AS (SELECT page, part, col, k, 0, y FROM vk WHERE k = 1
  UNION ALL SELECT vk.page, vk.part, vk.col, vk.k, w.grp + CASE WHEN abs(w.head - vk.y) > bs * 0.9 THEN 1 ELSE 0 END, CASE WHEN abs(w.head - vk.y) > bs * 0.9 THEN vk.y ELSE w.head END FROM w JOIN vk ON vk.page = w.page AND vk.part = w.part AND vk.col = w.col AND vk.k = w.k + 1),
x AS (SELECT vk.page, vk.seq, vk.part, vk.col, CASE WHEN bycol THEN grp ELSE 0 END AS grp, vk.x, vk.y, max(vk.y) OVER (PARTITION BY vk.page, vk.part) AS head FROM vk JOIN w USING (page, part, col, k))
SELECT page, seq, CAST(dense_rank() OVER (PARTITION BY page ORDER BY head DESC, part) AS INT) AS line, CAST(row_number() OVER (PARTITION BY page ORDER BY head DESC, part, col, grp, x, y DESC, seq) AS INT) AS "order" FROM x"""

_BOX = """user_id AS page, event_id AS id, event_id % 5 * 60e0 + event_id % 3 * 0.5e0 AS x0, event_id % 5 * 60e0 + event_id % 3 * 0.5e0 + CASE WHEN event_type IN ('error', 'signup') THEN 40 + event_id % 50 ELSE 0.5e0 END AS x1,
 floor(value / 2) * 9e0 + event_id % 4 AS y0, floor(value / 2) * 9e0 + event_id % 4 + CASE WHEN event_type IN ('error', 'signup') THEN 0.5e0 WHEN event_id % 7 = 0 THEN 5 ELSE 10 + event_id % 6 END AS y1"""


def t64_tables(spark: SparkSession, d: str) -> DataFrame:
    return geometry.find_tables(table(spark, d, "events").selectExpr(*_fields(_BOX)), "page")


T64 = f"""WITH RECURSIVE e AS (SELECT {_BOX} FROM events),
v AS (SELECT page, id, round((x0 + x1) / 2, 2) AS x, round(y0, 2) AS y0, round(y1, 2) AS y1 FROM e WHERE NOT (y1 - y0 <= 2.5 AND x1 - x0 >= 4) AND x1 - x0 <= 2.5 AND y1 - y0 >= 8),
n AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM v u WHERE u.page = v.page AND (u.y1 > v.y1 OR (u.y1 = v.y1 AND u.id < v.id)) AND least(u.y1, v.y1) - greatest(u.y0, v.y0) > 4) THEN 0 ELSE 1 END AS new FROM v),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y1 DESC, id) AS grp FROM n),
w AS (SELECT page, grp, min(x) AS x0, max(x) AS x1, min(y0) AS y0, max(y1) AS y1 FROM g GROUP BY 1, 2 HAVING count(*) >= 3),
h AS (SELECT page, round(x0, 2) AS l, round(x0, 2) + round(x1 - x0, 2) AS r, round((y0 + y1) / 2, 2) AS y FROM e WHERE y1 - y0 <= 2.5 AND x1 - x0 >= 4),
x AS (SELECT w.page, w.grp, min(l) AS l, max(r) AS r FROM w JOIN h ON h.page = w.page AND h.y BETWEEN w.y0 - 3 AND w.y1 + 3 AND r > w.x0 - 3 AND l < w.x1 + 3 GROUP BY 1, 2),
f AS (SELECT w.page, least(x0, coalesce(l, x0)) - 2 AS x0, y0 - 2 AS y0, greatest(x1, coalesce(r, x1)) + 2 AS x1, y1 + 2 AS y1, row_number() OVER (PARTITION BY w.page ORDER BY y1 DESC, w.grp) AS k FROM w LEFT JOIN x USING (page, grp)),
s(it, page, k, st) AS (SELECT 0, page, CAST(1 AS BIGINT), [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] FROM f WHERE k = 1
  UNION ALL SELECT it + 1, page, CASE WHEN fit THEN k ELSE k + 1 END, CASE WHEN fit THEN list_append(st[:-3], {{'x0': least(st[-2].x0, st[-1].x0), 'y0': least(st[-2].y0, st[-1].y0), 'x1': greatest(st[-2].x1, st[-1].x1), 'y1': st[-2].y1}}) ELSE list_append(st, box) END
  FROM (SELECT s.*, f.page IS NOT NULL AS more, {{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}} AS box,
    coalesce(least(st[-2].x1, st[-1].x1) - greatest(st[-2].x0, st[-1].x0) > 0.8 * least(st[-2].x1 - st[-2].x0, st[-1].x1 - st[-1].x0) AND st[-2].y0 - st[-1].y1 < 6, false) AS fit FROM s LEFT JOIN f ON f.page = s.page AND f.k = s.k + 1) WHERE fit OR more),
z AS (SELECT page, st FROM s QUALIFY it = max(it) OVER (PARTITION BY page)), y AS (SELECT page, unnest(range(1, len(st) + 1)) AS i, st FROM z)
SELECT page, CAST(i - 1 AS INT) AS tid, round(st[i].x0, 2) AS x0, round(st[i].y0, 2) AS y0, round(st[i].x1, 2) AS x1, round(st[i].y1, 2) AS y1 FROM y"""


def j22_regions(spark: SparkSession, d: str) -> DataFrame:
    return geometry.formula_regions(*_page(spark, d), "page")


J22 = f"""WITH RECURSIVE {_RUNS}, {_BODY},
a AS (SELECT r.page, seq, x, x1, y, size, text, bs FROM r JOIN b USING (page)),
s AS (SELECT a.page, seq AS sign, rule FROM a JOIN u USING (page) WHERE regexp_matches(text, '^\\s*[√∛∜]\\s*$') AND abs(u.x - a.x1) <= 10 AND u.y - a.y > 0 AND u.y - a.y <= bs * 4.5 QUALIFY row_number() OVER (PARTITION BY a.page, seq ORDER BY u.y DESC, rule) = 1),
o AS (SELECT page, rule, max(sign) AS sign FROM s GROUP BY 1, 2),
n AS (SELECT a.page, u.rule, seq, sign FROM a JOIN u ON u.page = a.page LEFT JOIN o ON o.page = u.page AND o.rule = u.rule
  WHERE least(x1, u.x + w) - greatest(a.x, u.x) >= 0.55 * greatest(1e-6, x1 - a.x) AND ((a.y - u.y > 0.5 AND a.y - u.y <= bs * 1.6 AND sign IS NULL) OR (u.y - a.y > 0.5 AND u.y - a.y <= bs * 1.6))),
m AS (SELECT page, rule, seq FROM n UNION ALL SELECT DISTINCT page, rule, sign FROM n WHERE sign IS NOT NULL),
k AS (SELECT page, rule, seq FROM m QUALIFY count(*) OVER (PARTITION BY page, rule) >= 2),
p AS (SELECT DISTINCT x.page, x.rule AS f, y.rule AS t FROM k x JOIN k y ON x.page = y.page AND x.seq = y.seq),
c AS (SELECT page, f, t FROM p UNION SELECT c.page, c.f, p.t FROM c JOIN p ON p.page = c.page AND p.f = c.t),
q AS (SELECT page, f AS rule, min(t) AS region FROM c GROUP BY 1, 2),
g0 AS (SELECT DISTINCT k.page, region, k.seq, 0 AS grown FROM k JOIN q USING (page, rule)),
g1 AS (SELECT * FROM g0 UNION ALL SELECT e.page, e.region, a.seq, 1 FROM (SELECT g.page, region, max(x1) AS edge FROM g0 g JOIN a USING (page, seq) GROUP BY 1, 2) e JOIN a ON a.page = e.page AND size < bs * 0.86 AND x - edge BETWEEN -1.0 AND bs * 0.6
  WHERE NOT EXISTS (SELECT 1 FROM g0 g WHERE g.page = e.page AND g.region = e.region AND g.seq = a.seq) AND EXISTS (SELECT 1 FROM g0 g JOIN a i USING (page, seq) WHERE g.page = e.page AND g.region = e.region AND abs(a.y - i.y) <= a.bs * 0.9)),
g2 AS (SELECT * FROM g1 UNION ALL SELECT e.page, e.region, a.seq, 2 FROM (SELECT g.page, region, max(x1) AS edge FROM g1 g JOIN a USING (page, seq) GROUP BY 1, 2) e JOIN a ON a.page = e.page AND size < bs * 0.86 AND x - edge BETWEEN -1.0 AND bs * 0.6
  WHERE NOT EXISTS (SELECT 1 FROM g1 g WHERE g.page = e.page AND g.region = e.region AND g.seq = a.seq) AND EXISTS (SELECT 1 FROM g1 g JOIN a i USING (page, seq) WHERE g.page = e.page AND g.region = e.region AND abs(a.y - i.y) <= a.bs * 0.9)),
g3 AS (SELECT * FROM g2 UNION ALL SELECT e.page, e.region, a.seq, 3 FROM (SELECT g.page, region, max(x1) AS edge FROM g2 g JOIN a USING (page, seq) GROUP BY 1, 2) e JOIN a ON a.page = e.page AND size < bs * 0.86 AND x - edge BETWEEN -1.0 AND bs * 0.6
  WHERE NOT EXISTS (SELECT 1 FROM g2 g WHERE g.page = e.page AND g.region = e.region AND g.seq = a.seq) AND EXISTS (SELECT 1 FROM g2 g JOIN a i USING (page, seq) WHERE g.page = e.page AND g.region = e.region AND abs(a.y - i.y) <= a.bs * 0.9))
SELECT page, region, seq AS atom, grown FROM g3"""

_CHAR = """user_id AS page, event_id AS seq, left(event_type, 1) AS text, event_id * 11 % 90 * 3e0 AS x, event_id * 11 % 90 * 3e0 + 2.5e0 AS x1, floor(value / 30) * 8e0 + event_id % 2 * 0.5e0 AS y,
 floor(value / 30) * 8e0 + 7 AS yt, 10e0 + event_id % 10 * 0.05e0 AS size, event_id % 5 % 2 * 90 AS angle"""


def s1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Characters that run to the right, and others upward, at places of their own."""
    return geometry.text_runs(table(spark, d, "events").selectExpr(*_fields(_CHAR)), "page")


S1 = f"""WITH RECURSIVE e AS (SELECT {_CHAR} FROM events),
c AS (SELECT page, CAST(angle AS INT) AS angle, seq, text, size, CASE angle WHEN 90 THEN y ELSE x END AS x, CASE angle WHEN 90 THEN yt ELSE x1 END AS x1, CASE angle WHEN 90 THEN -x1 ELSE y END AS y, CASE angle WHEN 90 THEN -x ELSE yt END AS yt FROM e),
o AS (SELECT *, lag(x1) OVER w AS gap, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY page, angle ORDER BY round(y, 1) DESC, x, seq)),
b AS (SELECT o.*, x - gap >= 0.3 AND EXISTS (SELECT 1 FROM c m WHERE m.page = o.page AND m.angle = o.angle AND m.x < o.x AND m.x1 > o.gap AND abs(m.y - o.y) >= 0.8) AS stop FROM o),
r(page, angle, k, run, x1, y, size) AS (SELECT page, angle, k, 1, x1, y, size FROM b WHERE k = 1
  UNION ALL SELECT page, angle, k, run + new, x1, CASE new WHEN 1 THEN ny ELSE y END, CASE new WHEN 1 THEN ns ELSE size END
  FROM (SELECT b.page, b.angle, b.k, r.run, b.x1, r.y, r.size, b.y AS ny, b.size AS ns, CASE WHEN abs(r.y - b.y) < 0.8 AND abs(r.size - b.size) < 0.35 AND b.x - r.x1 BETWEEN -0.6 AND greatest(1.2, b.size * 0.45) AND NOT b.stop THEN 0 ELSE 1 END AS new FROM r JOIN b ON b.page = r.page AND b.angle = r.angle AND b.k = r.k + 1))
SELECT page, angle, run, string_agg(text, '' ORDER BY k) AS text, round(arg_min(b.x, k), 2) AS x, round(arg_max(b.x1, k), 2) AS x1, round(arg_min(b.y, k), 2) AS y, round(max(yt), 2) AS yt, round(arg_min(b.size, k), 2) AS size FROM r JOIN b USING (page, angle, k) GROUP BY 1, 2, 3"""

_PART = "user_id AS scene, event_id AS id, event_id % 6 * 50e0 AS x0, event_id % 5 * 40e0 AS y0, event_id % 6 * 50e0 + 30 AS x1, event_id % 5 * 40e0 + event_id % 20 AS y1"
_LABEL = """user_id AS scene, event_id AS id, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN concat(event_type, '磁场') ELSE event_type END AS text, CASE WHEN event_id % 31 = 0 THEN -1 ELSE event_id - 15 + event_id % 2 * 15 END AS of,
 CASE event_id % 7 WHEN 0 THEN 'above' WHEN 1 THEN 'below' WHEN 2 THEN 'left' WHEN 3 THEN 'right' WHEN 4 THEN 'center' WHEN 5 THEN NULL ELSE 'elsewhere' END AS side, CASE event_id % 3 WHEN 0 THEN 'end' WHEN 1 THEN 'start' END AS anchor,
 CASE WHEN event_id % 9 = 0 THEN 100e0 END AS px, CASE WHEN event_id % 9 = 0 THEN 50e0 END AS py"""


def j23_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of views, clicks and errors that hang on the others, or on nothing, or stand where they say."""
    events = table(spark, d, "events")
    parts = events.where("event_type IN ('purchase', 'signup', 'view')").selectExpr(*_fields(_PART))
    labels = events.where("event_type <> 'purchase' AND event_id % 3 <> 2").selectExpr(*_fields(_LABEL))
    return geometry.settle_labels(labels, parts, "scene")


J23 = f"""WITH RECURSIVE p AS (SELECT {_PART} FROM events WHERE event_type IN ('purchase', 'signup', 'view')), l AS (SELECT {_LABEL} FROM events WHERE event_type <> 'purchase' AND event_id % 3 <> 2),
a AS (SELECT l.scene, l.id, l.side, l.anchor, 6.0 * len(regexp_replace(text, '[^\\x00-⹿]', '', 'g')) + 13.1 * len(regexp_replace(text, '[\\x00-⹿]', '', 'g')) AS w,
  CASE WHEN px IS NOT NULL THEN px WHEN l.side = 'left' THEN x0 - 6 WHEN l.side = 'right' THEN x1 + 6 ELSE (x0 + x1) / 2 END AS x,
  CASE WHEN py IS NOT NULL THEN py WHEN coalesce(l.side, 'above') = 'above' THEN y0 - 6 WHEN l.side = 'below' THEN y1 + 14.9 WHEN l.side IN ('left', 'right', 'center') THEN (y0 + y1) / 2 + 4 ELSE (y0 + y1) / 2 END AS y, row_number() OVER (PARTITION BY l.scene ORDER BY l.seq, l.id) AS k
  FROM l LEFT JOIN p ON p.scene = l.scene AND p.id = l.of),
b AS (SELECT *, x - CASE coalesce(anchor, 'middle') WHEN 'middle' THEN w / 2 WHEN 'end' THEN w ELSE 0 END AS lo, CASE WHEN side = 'above' THEN -4 ELSE 4 END AS step FROM a),
s(scene, k, placed, id, y, outcome) AS (SELECT scene, CAST(0 AS BIGINT), CAST([] AS STRUCT(t DOUBLE, l DOUBLE, r DOUBLE)[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), '' FROM (SELECT DISTINCT scene FROM b)
  UNION ALL SELECT scene, k, CASE WHEN y IS NULL THEN placed ELSE list_append(placed, {{'t': y + step * n - 14.9 * 0.78, 'l': CAST(lo AS DOUBLE), 'r': CAST(lo + w AS DOUBLE)}}) END, id, y + step * n, CASE WHEN y IS NULL THEN 'lost' WHEN n = 12 THEN 'crowded' ELSE 'placed' END
  FROM (SELECT b.*, s.placed, coalesce(list_min(list_filter(range(0, 12), lambda i: len(list_filter(s.placed, lambda q: NOT (b.lo + b.w <= q.l OR q.r <= b.lo OR b.y + b.step * i - 14.9 * 0.78 + 14.9 <= q.t OR q.t + 14.9 <= b.y + b.step * i - 14.9 * 0.78))) = 0)), 12) AS n FROM s JOIN b ON b.scene = s.scene AND b.k = s.k + 1))
SELECT s.scene, s.id, CASE WHEN s.y IS NOT NULL THEN CAST(b.x AS DOUBLE) END AS x, s.y, s.outcome FROM s JOIN b ON b.scene = s.scene AND b.k = s.k"""

QUERIES = {
    "w4_pages": (w4_pages, W4), "t64_tables": (t64_tables, T64), "j22_regions": (j22_regions, J22), "s1_runs": (s1_runs, S1), "j23_labels": (j23_labels, J23),
}
