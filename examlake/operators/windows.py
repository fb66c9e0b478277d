"""Ordered operators: running offsets, islands, chains, folds over ordered arrays, capped picks.

Each works within a key; orders are total. Where the next step depends on earlier decisions, not rows, the key's rows
are streamed in order through a fold (:mod:`folds`).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed


def flow_offsets(spans: DataFrame, by: str, order: Sequence[str], text: str) -> DataFrame:
    """Where each span begins in the text of all spans of its key."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.char_length(text)).over(before), F.lit(0)))


def islands(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """Runs of neighbours with the same value: (by, run, value, first, last, length)."""
    line = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(value).over(line).eqNullSafe(F.col(value)) & (F.row_number().over(line) > 1), 0).otherwise(1)
    marked = rows.withColumn("_change", change)
    marked = marked.withColumn("run", F.sum("_change").over(line))
    return marked.groupBy(by, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def separators(runs: DataFrame, by: str, order: Sequence[str], y: str, x: str, x1: str, size: str) -> DataFrame:
    """A space before a run on a new line, or that stands off the previous one."""
    line = Window.partitionBy(by).orderBy(*order)
    new_line = F.abs(F.col(y) - F.lag(y).over(line)) > 0.6 * F.col(size)
    gap = F.col(x) - F.lag(x1).over(line) > 0.3 * F.col(size)
    return runs.withColumn("separator", F.when(new_line | gap, " ").otherwise(""))


def spans_until_next(anchors: DataFrame, by: str, at: str, end: Column) -> DataFrame:
    """From each anchor to the next, the last to ``end``."""
    return anchors.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(by).orderBy(at)), end))


def number_chain(rows: DataFrame, by: str, order: Sequence[str], number: str, least: int = 4) -> DataFrame:
    """How far 1, 2, 3, ... can be followed in order; none below ``least``. The first 1 reaches as far as any."""

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        chain = 0
        for (x,) in own:
            chain += x == chain + 1
        yield (chain,)

    some = rows.select(by, *order, F.col(number).cast("long").alias("_v"))
    return streamed(some, by, [*order, "_v"], ["_v"], each, "chain long").withColumn("accepted", F.col("chain") >= least)


def strips(marks: DataFrame, by: str, order: Sequence[str], n: str, y: str, height: int, most: int = 8, tall: int = 260, thin: int = 24, pad: float = 0.05, least: int = 3, share: float = 0.6) -> DataFrame:
    """(by, strips, dropped): a page's numbered marks to strips of at most ``most`` marks or about ``tall`` pixels.

    Marks with ``y`` outside 0 to 1 are passed over. In order of number, the longest strictly rising subsequence of ``y`` is
    kept and the others are ``dropped``; if there are any, and fewer are kept than ``least`` or a ``share``, none is cut and
    all are dropped. A strip below ``thin`` pixels does not end. ``strips`` is array<struct<numbers, top, bottom>>. A page
    has some dozens of marks; a fold keeps those of one page.
    """

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        rows = [(k, v) for k, v in own if k is not None and v is not None and 0 <= v <= 1]
        if not rows:
            yield [], []
            return
        # by length of the rising subsequence that ends there: ys of a level never rise, so the first fitting one is searched
        levels: list[list[tuple[float, int]]] = []
        before: list[int | None] = []
        for i, (_, v) in enumerate(rows):
            depth = _depth(levels, v)
            before.append(None if depth == 0 else _first_below(levels[depth - 1], v))
            if depth == len(levels):
                levels.append([])
            levels[depth].append((v, i))
        kept, at = [], levels[-1][0][1]
        while at is not None:
            kept.append(at)
            at = before[at]
        kept.reverse()
        if len(kept) < len(rows) and len(kept) < max(least, share * len(rows)):
            yield [], [k for k, _ in rows]
            return
        there = set(kept)
        groups: list[list[tuple[int, float]]] = []
        for k, v in (rows[i] for i in kept):
            deep = (v - groups[-1][0][1]) * height if groups else 0
            if not groups or ((len(groups[-1]) >= most or deep >= tall) and deep >= thin):
                groups.append([(k, v)])
            else:
                groups[-1].append((k, v))
        ends = [*(int(g[0][1] * height) for g in groups[1:]), height]
        yield [([k for k, _ in g], max(0, int((g[0][1] - pad) * height)), e) for g, e in zip(groups, ends, strict=True)], [k for i, (k, _) in enumerate(rows) if i not in there]

    some = marks.select(by, *order, F.col(n).cast("long").alias("_n"), F.col(y).cast("double").alias("_y"))
    return streamed(some, by, ["_n", *order], ["_n", "_y"], each, "strips array<struct<numbers:array<bigint>,top:int,bottom:int>>, dropped array<bigint>")


def _depth(levels: list[list[tuple[float, int]]], v: float) -> int:
    """How many levels end below ``v``: the last, smallest y of a level is what counts."""
    return bisect_left(levels, v, key=lambda own: own[-1][0])


def _first_below(level: list[tuple[float, int]], v: float) -> int:
    """The earliest mark of a level, whose ys never rise, that is below ``v``."""
    return level[bisect_right(level, -v, key=lambda x: -x[0])][1]


def rows_by_top(figures: DataFrame, by: str, order: Sequence[str], top: str, tolerance: float) -> DataFrame:
    """Rows of figures: one joins a row if its top is near that of the row's first figure. (by, n_rows, sizes)."""

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        anchor, sizes = None, []
        for (x,) in own:
            if anchor is not None and x is not None and abs(x - anchor) <= tolerance:
                sizes[-1] += 1
            else:
                anchor = x
                sizes.append(1)
        yield len(sizes), ",".join(map(str, sizes))

    some = figures.select(by, *order, F.col(top).cast("double").alias("_v"))
    return streamed(some, by, [*order, "_v"], ["_v"], each, "n_rows int, sizes string")


def monotonic_slices(marks: DataFrame, by: str, n: str, y: str, height: Column) -> DataFrame:
    """Slices from each mark to the next; a key whose marks do not rise strictly has none at all."""
    line = Window.partitionBy(by).orderBy(n)
    good = F.coalesce(F.col(y) > F.lag(y).over(line), F.lit(True)) & F.coalesce(F.col(n) > F.lag(n).over(line), F.lit(True))
    cut = marks.withColumn("_good", good).withColumn("until", F.coalesce(F.lead(y).over(line), height))
    return cut.withColumn("_all", F.bool_and("_good").over(Window.partitionBy(by))).where("_all").drop("_good", "_all")


def pick_capped(candidates: DataFrame, by: str, score: str, n: str, need: Column, cap: int = 6) -> DataFrame:
    """K1: the best ``cap`` of those needed are picked; the others say why not."""
    needed = candidates.withColumn("_need", F.coalesce(need, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(by, "_need").orderBy(F.desc_nulls_last(score), n))
    ranked = needed.withColumn("_rank", rank)
    return ranked.withColumn("picked", F.col("_need") & (F.col("_rank") <= cap)).withColumn("why", F.when(~F.col("_need"), "not needed").when(F.col("_rank") > cap, "over the cap").otherwise("")).drop("_need", "_rank")


def natural_key(name: Column) -> Column:
    """K2 and K3: a sort key of a path's last part, whatever its case, in which runs of digits count as numbers of any length.

    A number is the count of its digits and the digits; other text comes before numbers above 0, as if it were 0.
    """
    parts = F.regexp_extract_all(F.regexp_extract(name, r"([^/]*)$", 1), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(F.concat(F.lit("0000"), F.lower(x)))

    return F.array_join(F.transform(parts, key), "\u0001")


def reading(page: str, y: str) -> list[Column]:
    """K4: what reading order sorts by: pages upward, and y downward within a page."""
    return [F.asc(page), F.desc(y)]


def nearest_full_size(atoms: DataFrame, by: str, order: Sequence[str], full: Column, value: str, back: int = 3) -> DataFrame:
    """The value of the nearest of the few atoms before that has full size; null if none of them has."""
    line = Window.partitionBy(by).orderBy(*order).rowsBetween(-back, -1)
    return atoms.withColumn("base", F.last(F.when(full, F.col(value)), ignorenulls=True).over(line))


def sample_grid(cases: DataFrame, points: int) -> DataFrame:
    """Each case at evenly spaced u from 0 to 1."""
    return cases.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("u", F.col("i") / (points - 1))


def interleave(rows: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """K6: a text cut at its placeholders, pieces and placeholders in order, empty pieces left out."""
    marks = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    pieces = F.split(text, mark, -1)
    both = F.flatten(F.transform(F.arrays_zip(pieces.alias("t"), F.concat(marks, F.array(F.lit(""))).alias("m")), lambda x: F.array(x["t"], x["m"])))
    return rows.select(key, F.posexplode(F.filter(both, lambda x: x != "")).alias("position", "part"))
