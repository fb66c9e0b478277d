"""Page layout: joins by place, reading order, rows and grids, connected rules. Distances are in points, y grows upward."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed, with_upper_median


def merge_runs(chars: DataFrame, page: str) -> DataFrame:
    """Characters to runs: same baseline and size, and close to the one before; (page, run, text, x, x1, y)."""
    line = Window.partitionBy(page).orderBy("seq")
    gap = F.col("x") - F.lag("x1").over(line)
    near = (F.abs(F.col("y") - F.lag("y").over(line)) < 0.8) & (F.abs(F.col("size") - F.lag("size").over(line)) < 0.35) & (gap >= -0.6) & (gap <= F.greatest(F.lit(1.2), 0.45 * F.col("size")))
    marked = chars.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("_new").over(line)).groupBy(page, "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "")
    return runs.agg(text.alias("text"), F.min("x").alias("x"), F.max("x1").alias("x1"), F.min("y").alias("y"))


def carry_over(rows: DataFrame, by: str, order: Sequence[str], number: str) -> DataFrame:
    """The largest number on earlier rows, carried to each."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried", F.max(number).over(before))


def mode_first(rows: DataFrame, by: str, value: str, order: str, default: Column) -> DataFrame:
    """The most frequent value, the one seen first at a tie."""
    per = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = per.groupBy(by).agg(F.max(F.struct("_n", (-F.col("_first")).alias("_f"), value)).alias("b"))
    return rows.select(by).distinct().join(best, by, "left").select(by, F.coalesce(f"b.{value}", default).alias(value))


def baseline(atoms: DataFrame, by: str, value: str, order: str, full: Column) -> DataFrame:
    """The most frequent value of the atoms of full size, of all atoms where none is; the one seen first at a tie."""
    large = mode_first(atoms.withColumn(value, F.when(full, F.col(value))), by, value, order, F.lit(None)).withColumnRenamed(value, "_large")
    return large.join(mode_first(atoms, by, value, order, F.lit(None)), by).select(by, F.coalesce("_large", value).alias(value))


def link_continuations(tables: DataFrame, body: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """A table's root: the lowest table of the page before, if edges agree and no body text stands between.

    A chain goes on through pages that hold one table alone, so chains are islands of neighbouring pages, and a root is
    carried along its island in one ordered pass.
    """
    low, high = Window.partitionBy("doc", "page").orderBy("y0", "tid"), Window.partitionBy("doc", "page").orderBy(F.desc("y1"), "tid")
    ranked = tables.withColumn("_low", F.row_number().over(low)).withColumn("_high", F.row_number().over(high)).withColumn("_n", F.count("*").over(Window.partitionBy("doc", "page")))
    above = ranked.where("_low = 1").select("doc", (F.col("page") + 1).alias("page"), F.col("tid").alias("parent"), F.col("x0").alias("px0"), F.col("x1").alias("px1"))
    between = body.groupBy("doc", "page").agg(F.max("y").alias("_text"))
    first = ranked.where("_high = 1").join(above, ["doc", "page"], "left").join(between, ["doc", "page"], "left")
    agrees = (F.abs(F.col("x0") - F.col("px0")) <= tolerance) & (F.abs(F.col("x1") - F.col("px1")) <= tolerance) & ~F.coalesce(F.col("_text") > F.col("y1"), F.lit(False))
    linked = first.withColumn("parent", F.when(agrees, F.col("parent")))
    line = Window.partitionBy("doc").orderBy("page")
    goes_on = (F.lag("page").over(line) == F.col("page") - 1) & F.lag("parent").over(line).isNotNull() & (F.lag("_n").over(line) == 1)
    linked = linked.withColumn("_seed", F.when(F.col("parent").isNotNull() & ~F.coalesce(goes_on, F.lit(False)), F.col("parent")))
    carried = F.last("_seed", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    roots = linked.select("doc", "tid", F.when(F.col("parent").isNotNull(), carried).otherwise(F.col("tid")).alias("root"))
    others = ranked.where("_high > 1").select("doc", "tid", F.col("tid").alias("root"))
    return roots.unionByName(others)


def place_figures(figures: DataFrame, spans: DataFrame) -> DataFrame:
    """Each figure stands before the first span, in reading order, that begins below its top; else at the end (null)."""
    below = figures.join(spans.select("page", "seq", F.col("y").alias("_y")), "page").where(F.col("_y") <= F.col("top"))
    where = below.groupBy("figure").agg(F.min("seq").alias("before"))
    return figures.join(where, "figure", "left")


def fold_tables(spans: DataFrame, boxes: DataFrame, least: int = 3) -> DataFrame:
    """Spans inside a table's box, if it holds at least so many; joined on the page, of which a box is a part."""
    inside = spans.join(boxes, "page").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.withColumn("_n", F.count("*").over(Window.partitionBy("page", "tid"))).where(F.col("_n") >= least).drop("_n")


def overlaps(boxes: DataFrame, frame: str, fail: float = 5.0, warn: float = 2.5) -> DataFrame:
    """The worst overlap of each two boxes over all frames; a frame has a page's few boxes, so pairs are by frame."""
    a = boxes.select(frame, *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h")])
    b = boxes.select(frame, *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")])
    side = lambda p, s: F.least(F.col(f"a_{p}") + F.col(f"a_{s}"), F.col(f"b_{p}") + F.col(f"b_{s}")) - F.greatest(f"a_{p}", f"b_{p}")
    depth = F.least(side("x", "w"), side("y", "h"))
    worst = a.join(b, frame).where("a_id < b_id").withColumn("depth", depth).where("depth > 0").groupBy("a_id", "b_id").agg(F.max("depth").alias("depth"))
    return worst.withColumn("level", F.when(F.col("depth") >= fail, "fail").when(F.col("depth") >= warn, "warn").otherwise("ok"))


def typography(lines: DataFrame, by: str, order: Sequence[str], y: str, left: str, least: int = 5, top: int = 3) -> DataFrame:
    """Candidate headings: lines after a gap of 1.6 times the upper median, by left margin; the largest groups."""
    line = Window.partitionBy(by).orderBy(*order)
    gaps = lines.withColumn("gap", F.abs(F.col(y) - F.lag(y).over(line))).where("gap is not null")
    middle = with_upper_median(gaps, by, F.col("gap"), "_m").groupBy(by).agg(F.max("_m").alias("median"))
    kept = gaps.join(middle, by).where(F.col("gap") >= 1.6 * F.col("median")).groupBy(by, (F.floor(F.col(left) / 6) * 6).alias("margin")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "margin"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top)


def y_bounds(spans: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Smallest and largest y of each question on each page."""
    return spans.groupBy(*keys).agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def option_figures(figures: DataFrame, question: str, options: int) -> DataFrame:
    """Of a question's figures, the last run of whole rows that has as many as there are options and is a grid.

    Rows are those of :func:`windows.rows_by_top`; a grid has rows of equal length on one page, with columns that align
    and boxes alike in size. A question's figures are streamed in order, one question after another.
    """

    def known(boxes: list[tuple], at: int) -> list[float]:
        return [b[at] for b in boxes if b[at] == b[at]]

    def grid(rows: list[list[tuple]]) -> bool:
        every = [b for r in rows for b in r]
        if len({len(r) for r in rows}) != 1 or len(rows[0]) < 2 or len({b[1] for b in every} - {None}) > 1:
            return False
        w, h = known(every, 4), known(every, 5)
        if not w or not all(known(r, 5) for r in rows):
            return False
        alike = max(w) - min(w) <= 0.4 * max(w) and max(h) - min(h) <= 0.3 * max(h)
        apart = all(b[2] >= a[2] + a[4] for r in rows for a, b in pairwise(r))
        columns = all(abs(b[2] - a[2]) <= 3 for r in rows for a, b in zip(r, rows[0], strict=True))
        close = all(a[0][3] - max(known(a, 5)) - b[0][3] <= max(h) for a, b in pairwise(rows))
        return alike and apart and columns and close

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        rows: list[list[tuple]] = []
        for figure, page, *box in own:
            b = (figure, page, *(math.nan if v is None else v for v in box))
            if rows and page is not None and page == rows[-1][0][1] and abs(b[3] - rows[-1][0][3]) <= 3:
                rows[-1].append(b)
            else:
                rows.append([b])
        before = list(accumulate(map(len, rows), initial=0))
        at = {n: k for k, n in enumerate(before)}
        chosen = range(0)
        for end in range(len(rows), 0, -1):
            start = at.get(before[end] - options)
            if start is not None and grid([sorted(r, key=lambda b: (b[2] != b[2], b[2], b[0])) for r in rows[start:end]]):
                chosen = range(start, end)
                break
        return ((b[0], k in chosen) for k, r in enumerate(rows) for b in r)

    boxes = figures.select(question, "figure", "page", *[F.col(c).cast("double").alias(c) for c in ("x", "top", "w", "h")])
    order = [F.col("page").asc_nulls_last(), F.col("top").desc_nulls_last(), F.col("x").asc_nulls_last(), "figure"]
    return streamed(boxes, question, order, ["figure", "page", "x", "top", "w", "h"], each, f"figure {dict(figures.dtypes)['figure']}, is_option boolean")


def connected_intervals(rules: DataFrame, by: str, low: str, high: str, overlap: float = 4.0) -> DataFrame:
    """T64 in part: groups of intervals that overlap their group by more than ``overlap``: (by, group, low, high, n)."""
    line = Window.partitionBy(by).orderBy(F.col(low).asc_nulls_last(), F.col(high).asc_nulls_last())
    reach = F.max(high).over(line.rowsBetween(Window.unboundedPreceding, -1))
    # rows alike in both ends keep one order, in which only the first can begin a group
    begun = rules.withColumn("_at", F.row_number().over(line)).withColumn("_new", F.when(F.col(low) + overlap < reach, 0).otherwise(1))
    grouped = begun.withColumn("group", F.sum("_new").over(Window.partitionBy(by).orderBy("_at")))
    return grouped.groupBy(by, "group").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n"))


def block_box(spans: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """The box around the spans of a block, as (keys, y_min, y_max, n, x_min, x_max), where there are at least so many."""
    return spans.groupBy(*keys).agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max")).where(F.col("n") >= least)


def scenes_of(papers: DataFrame, stored: DataFrame, files: DataFrame, files_first: bool = False) -> DataFrame:
    """A question's scene from the store or from a file whose excerpt its stem contains; which comes first is a choice."""
    squeezed = papers.withColumn("_stem", F.regexp_replace("stem", r"\s+", ""))
    named = squeezed.join(files.select("paper", "n", F.col("scene").alias("_file"), "excerpt"), ["paper", "n"], "left")
    fits = F.contains(F.col("_stem"), F.left(F.regexp_replace("excerpt", r"\s+", ""), F.lit(16)))
    both = named.withColumn("_file", F.when(fits, F.col("_file"))).join(stored.select("paper", "n", F.col("scene").alias("_db")), ["paper", "n"], "left")
    order = ("_file", "_db") if files_first else ("_db", "_file")
    return both.select("paper", "n", F.coalesce(*order).alias("scene")).where("scene is not null")


def place_labels(labels: DataFrame, scene: str, step: float = 4.0, most: int = 12) -> DataFrame:
    """Labels in order, each moved up until it covers none placed before, at most so often; else it is reported.

    Labels (label, seq, x, y, w, h) are streamed in order, one scene after another.
    """

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        placed: list[tuple[float, float, float, float]] = []
        for label, *box in own:
            x, y, w, h = (math.nan if v is None else v for v in box)
            free = False
            for _ in range(most + 1):
                free = all(x + w <= left or left + wide <= x or y + h <= low or low + high <= y for left, low, wide, high in placed)
                if free:
                    break
                y += step
            if free:
                placed.append((x, y, w, h))
            yield label, y if free and y == y else None, free

    boxes = labels.select(scene, "label", "seq", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    order = [F.col("seq").asc_nulls_last(), "label"]
    return streamed(boxes, scene, order, ["label", "x", "y", "w", "h"], each, f"label {dict(labels.dtypes)['label']}, y double, placed boolean")


def radical_lines(signs: DataFrame, rules: DataFrame, page: str, slack: float = 3.0) -> DataFrame:
    """The rule that is a radical sign's line: the topmost that begins at the sign's right edge and not below it."""
    near = signs.join(rules.select(page, "rule", F.col("x0").alias("_x0"), F.col("y").alias("_y")), page).where((F.abs(F.col("_x0") - F.col("x1")) <= slack) & (F.col("_y") >= F.col("y")))
    best = near.groupBy(page, "sign").agg(F.max(F.struct(F.col("_y"), (-F.col("rule")).alias("_r"))).alias("b"))
    return best.select(page, "sign", (-F.col("b._r")).alias("rule"))
