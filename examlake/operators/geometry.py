"""Pages as geometry: runs of characters, tables framed by rules, formula regions, reading order, labels that avoid each other.

Distances are in points, y grows upward but for labels, where it grows downward. Every table has a page (or scene) column; joins are within it, by cells where
pages may be large. What depends on the order of earlier decisions (rows of runs, stacks of boxes, placed labels) is a fold over a page's ordered rows;
what doesn't is joins, repeated until nothing changes. Rows with a null page or coordinate are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed
from .rounds import components, cut

# fixed values: characters that are radical signs, and how an option begins
RADICAL = r"^\s*[√∛∜]\s*$"
OPTION = r"^\s*[ABCD]\s*[.．、]"


def body_size(rows: DataFrame, page: str, default: float) -> DataFrame:
    """(page, bs): a page's most frequent size, the one seen first at a tie; sizes of 0 and null don't count."""
    per = rows.groupBy(page, "size").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    known = (F.col("size") != 0) & F.col("size").isNotNull()
    return per.groupBy(page).agg(F.max_by("size", F.when(known, F.struct("n", -F.col("first")))).alias("bs")).select(page, F.coalesce("bs", F.lit(default)).alias("bs"))


def turned(chars: DataFrame, angle: Column) -> DataFrame:
    """Characters of text that runs at 90, 180 or 270 degrees, in coordinates along their own line."""
    box = F.struct("x", "x1", "y", "yt")
    up = F.struct(F.col("y").alias("x"), F.col("yt").alias("x1"), (-F.col("x1")).alias("y"), (-F.col("x")).alias("yt"))
    down = F.struct((-F.col("yt")).alias("x"), (-F.col("y")).alias("x1"), F.col("x").alias("y"), F.col("x1").alias("yt"))
    back = F.struct((-F.col("x1")).alias("x"), (-F.col("x")).alias("x1"), (-F.col("yt")).alias("y"), (-F.col("y")).alias("yt"))
    return chars.withColumn("_box", F.when(angle == 90, up).when(angle == 270, down).when(angle == 180, back).otherwise(box)).drop("x", "x1", "y", "yt").select("*", "_box.*").drop("_box")


def text_runs(chars: DataFrame, page: str, cell: float = 24.0) -> DataFrame:
    """Characters (seq, text, x, x1, y, yt, size) to runs (page, angle, run, text, x, x1, y, yt, size).

    A character goes on with the run of the one before it, in order of lines and places, if their baselines, sizes and
    places agree and no character of another line stands over the gap. The direction of the text (``angle``, if there is such a column) is part
    of the page: lines of each direction are put together along it. Gaps and characters meet by cells of a page's width.
    """
    angle = F.col("angle").cast("int") if "angle" in chars.columns else F.lit(0)
    some = turned(chars.withColumn("angle", angle).where(F.trim("text") != ""), F.col("angle")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(page).isNotNull())
    key = [page, "angle"]
    line = Window.partitionBy(*key).orderBy(F.desc(F.round("y", 1)), "x", "seq")
    some = cut(some.withColumn("gap_from", F.lag("x1").over(line)).withColumn("at", F.row_number().over(line)))
    reach = F.greatest(F.lit(1.2), F.col("size") * 0.45)
    gaps = some.where((F.col("x") - F.col("gap_from") >= 0.3) & (F.col("x") - F.col("gap_from") <= reach)).select(*key, "at", F.col("gap_from").alias("low"), F.col("x").alias("high"), F.col("y").alias("base"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    marks = some.where("x1 >= x").select(*key, "x", "x1", "y", cells("x", "x1").alias("cell"))
    over = (F.col("x") < F.col("high")) & (F.col("x1") > F.col("low")) & (F.abs(F.col("y") - F.col("base")) >= 0.8)
    blocked = gaps.withColumn("cell", cells("low", "high")).join(marks, [*key, "cell"]).where(over).select(*key, "at").distinct().withColumn("blocked", F.lit(True))
    placed = some.join(blocked, [*key, "at"], "left").withColumn("line", F.struct(*key))

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        run, last = 0, None
        for at, x, x1, y, size, stop in own:
            near = last is not None and abs(last[1] - y) < 0.8 and abs(last[2] - size) < 0.35 and -0.6 <= x - last[0] <= max(1.2, size * 0.45)
            if near and not stop:
                last = (x1, *last[1:])
            else:
                run, last = run + 1, (x1, y, size)
            yield at, run

    numbered = streamed(placed.withColumn("size", F.coalesce("size", F.lit(0.0))), "line", ["at"], ["at", "x", "x1", "y", "size", "blocked"], each, "at int, run int").select("line.*", "at", "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda c: c["text"]), "")
    first = lambda c: F.round(F.min_by(c, "at"), 2).alias(c)
    joined = numbered.join(some, [*key, "at"]).groupBy(*key, "run")
    return joined.agg(text.alias("text"), first("x"), F.round(F.max_by("x1", "at"), 2).alias("x1"), first("y"), F.round(F.max("yt"), 2).alias("yt"), first("size"))


def thin_rules(boxes: DataFrame) -> DataFrame:
    """Boxes (x0, x1, y0, y1) that are lines, with ``kind``: ``h`` flat and 4 wide at least, ``v`` upright and 8 high at least."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((F.abs(high) <= 2.5) & (wide >= 4), "h").when((F.abs(wide) <= 2.5) & (high >= 8), "v")
    return boxes.withColumn("kind", kind).where("kind IS NOT NULL")


def find_tables(boxes: DataFrame, page: str) -> DataFrame:
    """Tables by their upright rules: (page, tid, x0, y0, x1, y1), from the top down.

    ``boxes`` has (id, x0, x1, y0, y1). Going down, a rule belongs to the group before it if it overlaps any member by more than 4; at least three make a table row. It
    is widened by the flat rules that cross it, and neighbours, of which one reaches over 80 % of the other's width and which lie less than 6 apart,
    become one, again and again.
    """
    rules = thin_rules(boxes).where(F.col(page).isNotNull())
    upright = rules.where("kind = 'v'").select(page, "id", F.round((F.col("x0") + F.col("x1")) / 2, 2).alias("x"), F.round("y0", 2).alias("y0"), F.round("y1", 2).alias("y1"))
    line = Window.partitionBy(page).orderBy(F.desc("y1"), "id")
    # rules come by their upper ends, and all are higher than 4, so the lowest end so far tells whether any is overlapped
    lowest = F.min("y0").over(line.rowsBetween(Window.unboundedPreceding, -1))
    grouped = upright.withColumn("new", F.when(F.col("y1") - lowest > 4, 0).otherwise(1)).withColumn("group", F.sum("new").over(line))
    rows = grouped.groupBy(page, "group").agg(F.count("*").alias("n"), *[f(c).alias(a) for f, c, a in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y0", "y0"), (F.max, "y1", "y1"))]).where("n >= 3").drop("n")
    flat = rules.where("kind = 'h'").select(page, F.round("x0", 2).alias("left"), (F.round("x0", 2) + F.round(F.col("x1") - F.col("x0"), 2)).alias("right"), F.round((F.col("y0") + F.col("y1")) / 2, 2).alias("y"))
    crosses = F.col("y").between(F.col("y0") - 3, F.col("y1") + 3) & (F.col("right") > F.col("x0") - 3) & (F.col("left") < F.col("x1") + 3)
    reach = rows.join(flat, page).where(crosses).groupBy(page, "group").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    framed = rows.join(reach, [page, "group"], "left").select(
        page, "group", (F.least("x0", "left") - 2).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.greatest("x1", "right") + 2).alias("x1"), (F.col("y1") + 2).alias("y1")
    )

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        stack: list[list[float]] = []
        for box in own:
            stack.append(list(box))
            while len(stack) > 1:
                a, b = stack[-2:]
                shared, narrower = min(a[2], b[2]) - max(a[0], b[0]), min(a[2] - a[0], b[2] - b[0])
                if not (shared > narrower * 0.8 and a[1] - b[3] < 6):
                    break
                stack[-2:] = [[min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), a[3]]]
        for tid, box in enumerate(stack):
            yield tid, *(round(v, 2) for v in box)

    return streamed(framed, page, [F.desc("y1"), "group"], ["x0", "y0", "x1", "y1"], each, "tid int, x0 double, y0 double, x1 double, y1 double")


def overlines(atoms: DataFrame, rules: DataFrame, body: DataFrame, page: str) -> DataFrame:
    """(page, rule, sign): the rules that are a radical sign's line; the topmost near the sign, and of its signs the last."""
    signs = atoms.where(F.col("text").rlike(RADICAL)).select(page, F.col("seq").alias("sign"), F.col("x1").alias("edge"), F.col("y").alias("base")).join(body, page)
    rise = F.col("y") - F.col("base")
    near = signs.join(rules.select(page, "rule", "x", "y"), page).where((F.abs(F.col("x") - F.col("edge")) <= 10) & (rise > 0) & (rise <= F.col("bs") * 4.5))
    best = near.groupBy(page, "sign").agg(F.min_by("rule", F.struct(-F.col("y"), "rule")).alias("rule"))
    return best.groupBy(page, "rule").agg(F.max("sign").alias("sign"))


def formula_regions(atoms: DataFrame, rules: DataFrame, page: str, rounds: int = 3) -> DataFrame:
    """(page, region, atom, grown): the atoms around a rule, of rules that share some, and small ones that follow.

    ``atoms`` has (seq, text, x, x1, y, size), ``rules`` (rule, x, y, w). A rule takes what lies close above and below it, a radical sign's line
    only what is below, and its sign. Rules that share atoms are one region, named by the smallest rule. Then, ``rounds`` times, small atoms that follow the region's
    right edge on the baseline of one of its atoms join it. ``grown`` is the round, 0 before. A rule with fewer than two atoms makes no region.
    """
    atoms = atoms.where(F.col(page).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    body = body_size(atoms, page, 10.5)
    atoms = cut(atoms.select(page, "seq", "text", "x", "x1", "y", "size").join(body, page))
    over = overlines(atoms.drop("bs"), rules, body, page)
    lines = rules.join(body, page).join(over, [page, "rule"], "left").select(page, "rule", F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"), F.col("y").alias("height"), "sign", "bs")
    reach = F.col("bs") * 1.6
    # an atom is looked for in its own stretch of the page and in the two beside it
    lined = lines.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("height") / reach) + k))).drop("bs")
    rise = F.col("y") - F.col("height")
    covered = F.least("x1", "right") - F.greatest("x", "left") >= 0.55 * F.greatest(F.lit(1e-6), F.col("x1") - F.col("x"))
    side = ((rise > 0.5) & F.col("sign").isNull()) | (rise < -0.5)
    near = atoms.withColumn("cell", F.floor(F.col("y") / reach)).join(lined, [page, "cell"]).where(covered & side & (F.abs(rise) <= reach))
    near = cut(near.select(page, "rule", "seq", "sign"))
    signs = near.where("sign IS NOT NULL").select(page, "rule", F.col("sign").alias("seq"), "sign").distinct()
    links = near.unionByName(signs)
    links = links.join(links.groupBy(page, "rule").agg(F.count("*").alias("n")).where("n >= 2"), [page, "rule"]).select(page, "rule", "seq")
    comp = components(links, page, "rule", "seq")
    found = links.join(comp, [page, "rule"]).select(page, F.col("comp").alias("region"), "seq").distinct().join(atoms.select(page, "seq", "x1", "y", "bs"), [page, "seq"]).withColumn("grown", F.lit(0))
    small = atoms.where(F.col("size") < F.col("bs") * 0.86).select(page, F.col("seq").alias("next"), F.col("x").alias("next_x"), F.col("x1").alias("next_x1"), F.col("y").alias("next_y"), F.floor(F.col("x") / F.col("bs")).alias("cell"))
    for k in range(1, rounds + 1):
        # an atom that follows begins in the stretch of the region's edge or in one beside it
        edge = found.groupBy(page, "region").agg(F.max("x1").alias("edge"), F.first("bs").alias("bs"))
        near = edge.withColumn("cell", F.explode(F.sequence(F.floor((F.col("edge") - 1.0) / F.col("bs")), F.floor((F.col("edge") + F.col("bs") * 0.6) / F.col("bs")))))
        follows = (F.col("next_x") - F.col("edge") >= -1.0) & (F.col("next_x") - F.col("edge") <= F.col("bs") * 0.6)
        beside = near.join(small, [page, "cell"]).where(follows).drop("bs")
        level = beside.join(found.select(page, "region", "y", "seq", "bs"), [page, "region"]).groupBy(page, "region", "next", "next_x1", "next_y").agg(
            F.bool_or(F.abs(F.col("next_y") - F.col("y")) <= F.col("bs") * 0.9).alias("level"), F.bool_or(F.col("seq") == F.col("next")).alias("there"), F.first("bs").alias("bs")
        )
        added = level.where("level AND NOT there").select(page, F.col("next").alias("seq"), "region", F.col("next_x1").alias("x1"), F.col("next_y").alias("y"), "bs", F.lit(k).alias("grown"))
        found = cut(found.unionByName(added))
    return found.select(page, "region", F.col("seq").alias("atom"), "grown")


def _first_lines(own: Iterator[tuple]) -> Iterator[tuple]:
    """Lines of runs that come from the top down: a run near the one before it, in a line that does not grow too high."""
    n, first, before = 0, None, None
    for seq, y, bs in own:
        if first is not None and (before - y > bs * 0.9 or first - y > bs * 1.15):
            n, first = n + 1, None
        first, before = y if first is None else first, y
        yield seq, n


def glued_lines(runs: DataFrame, rules: DataFrame, page: str) -> DataFrame:
    """``runs`` with lines that formulas span made one: ``line`` numbers them from the top.

    Neighbouring lines are glued by a bar that both lie at, by a radical's bar over the lower one whose sign is in the upper, and by a tall glyph that reaches
    over both; lines far apart never are. More runs in a line never undo that, so all lines that can be are glued in each round, until none is; pages
    where nothing moved leave the rounds.
    """
    body = body_size(runs, page, 10.5)
    start = streamed(runs.join(body, page), page, [F.desc("y"), "x", "seq"], ["seq", "y", "bs"], _first_lines, "seq long, line int")
    whole = cut(runs.join(body, page).select(page, "seq", "text", "x", "x1", "y", "yt", "size", "bs"))
    bars = rules.select(page, "rule", F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"), F.col("y").alias("height"))
    lies = F.least("x1", "right") - F.greatest("x", "left") >= 0.6 * F.greatest(F.lit(1e-6), F.col("x1") - F.col("x"))
    sign = F.col("text").rlike(RADICAL) & (F.col("left") - F.col("x1")).between(-2, 8)
    touches = cut(whole.join(bars, page).select(page, "rule", "height", "seq", lies.alias("lies"), sign.alias("sign")).where("lies OR sign"))
    now = cut(start.join(whole, [page, "seq"]).select(page, "seq", "line", "y", "yt", "bs"))
    ended = []
    order, of_page = Window.partitionBy(page).orderBy("line"), Window.partitionBy(page)
    while True:
        lines = now.groupBy(page, "line").agg(F.min("y").alias("bottom"), F.max("y").alias("head"), F.first("bs").alias("bs"))
        pairs = lines.select(page, F.col("line").alias("upper"), F.lead("line").over(order).alias("lower"), "bottom", F.lead("head").over(order).alias("head"), "bs").where(F.col("bottom") - F.col("head") <= F.col("bs") * 2.6)
        on = touches.join(now.select(page, "seq", "line"), [page, "seq"]).groupBy(page, "rule", "height", "line").agg(F.bool_or("lies").alias("lies"), F.bool_or("sign").alias("sign"))
        above, below = on.select(page, "rule", "height", F.col("line").alias("upper")), on.where("lies").select(page, "rule", F.col("line").alias("lower"))
        by_bar = pairs.join(above, [page, "upper"]).where(F.col("height").between(F.col("head") - 1, F.col("bottom") + 1)).join(below, [page, "lower", "rule"]).select(page, "lower")
        tall = now.where(F.col("yt") - F.col("y") > F.col("bs") * 1.4).select(page, "line", "y", "yt")
        reach = (F.col("yt") >= F.col("bottom") - 1) & (F.col("y") <= F.col("head") + 1)
        by_glyph = pairs.join(tall, page).where(F.col("line").isin(F.col("upper"), F.col("lower")) & reach).select(page, "lower")
        glued = by_bar.union(by_glyph).distinct().select(page, F.col("lower").alias("line"), F.lit(1).alias("glued"))
        fresh = F.when(F.col("glued").isNotNull(), 0).otherwise(1)
        number = lines.select(page, "line").join(glued, [page, "line"], "left").select(page, "line", (F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int").alias("to"), F.max("glued").over(of_page).isNotNull().alias("moved"))
        after = cut(now.join(number, [page, "line"]).withColumn("line", F.col("to")).drop("to"))
        ended.append(after.where("NOT moved"))
        now = after.where("moved").drop("moved")
        if not now.limit(1).count():
            return reduce(DataFrame.unionByName, ended).select(page, "seq", "line").join(whole, [page, "seq"])


def _columns(row: list[tuple], bs: float) -> list[list[tuple]]:
    """Runs of a line by column: a wide gap begins one. A run is (seq, x, x1, y, starts an option)."""
    out: list[list[tuple]] = []
    for r in sorted(row, key=lambda r: r[1]):
        if not out or r[1] - out[-1][-1][2] > bs * 2.5:
            out.append([])
        out[-1].append(r)
    return out


def _down(column: list[tuple], bs: float) -> list[tuple]:
    """A column's runs line by line, each from left to right."""
    lines: list[list[tuple]] = []
    for r in sorted(column, key=lambda r: -r[3]):
        if not lines or abs(lines[-1][0][3] - r[3]) > bs * 0.9:
            lines.append([])
        lines[-1].append(r)
    return [r for line in lines for r in sorted(line, key=lambda r: r[1])]


def _wrapped(row: list[tuple], below: list[tuple], bs: float) -> list[tuple] | None:
    """The runs of a line with those of the next, if these go on with its columns; else None."""
    columns = _columns(row, bs)
    gap = min(r[3] for r in row) - max(r[3] for r in below)
    if len(columns) < 2 or len(below) >= len(row) or not 0 < gap <= bs * 1.8 or any(r[4] for r in below):
        return None
    bands = [(min(r[1] for r in c) - bs, max(r[2] for r in c) + bs) for c in columns]
    if not all(any(low <= r[1] and r[2] <= high for low, high in bands) for r in below):
        return None
    for r in below:
        next(c for c, (low, high) in zip(columns, bands, strict=True) if low <= r[1] <= high).append(r)
    return [r for c in columns for r in _down(c, bs)]


def _read(own: Iterator[tuple]) -> Iterator[tuple]:
    """(seq, part, head, place) of a page's runs, line after line: lines that go on with columns are read by column."""

    def read(row: list[tuple], by_column: bool, bs: float) -> Iterator[tuple]:
        order = [r for c in _columns(row, bs) for r in _down(c, bs)] if by_column else sorted(row, key=lambda r: r[1])
        head = max(r[3] for r in row)
        return ((r[0], part, head, k) for k, r in enumerate(order))

    row: list[tuple] = []
    by_column, part = False, 0
    for _, line in groupby(own, key=lambda r: r[0]):
        below = list(line)
        bs, below = below[0][1], [r[2:] for r in below]
        joined = _wrapped(row, below, bs) if row else None
        if joined:
            row, by_column = joined, True
            continue
        if row:
            yield from read(row, by_column, bs)
            part += 1
        row, by_column = below, False
    if row:
        yield from read(row, by_column, bs)


def reading_order(runs: DataFrame, rules: DataFrame, page: str) -> DataFrame:
    """(page, seq, line, order) of runs (seq, text, x, x1, y, yt, size), with bars, radicals and wrapped columns read as one."""
    runs = runs.where(F.col(page).isNotNull() & F.col("x").isNotNull() & F.col("x1").isNotNull() & F.col("y").isNotNull()).withColumn("yt", F.coalesce("yt", "y"))
    runs = runs.withColumn("seq", F.col("seq").cast("long"))
    lines = glued_lines(runs, rules, page).withColumn("option", F.coalesce(F.col("text").rlike(OPTION), F.lit(False)))
    read = streamed(lines, page, ["line", F.desc("y"), "x", "seq"], ["line", "bs", "seq", "x", "x1", "y", "option"], _read, "seq long, part int, head double, place int")
    top = Window.partitionBy(page).orderBy(F.desc("head"), "part")
    return read.select(page, "seq", F.dense_rank().over(top).alias("line"), F.row_number().over(top.orderBy(F.desc("head"), "part", "place")).alias("order"))


# fixed values: widths of characters, height of a line of text, distance of a label from what it names, and how labels are moved
NARROW, WIDE, HEIGHT, GAP, STEP, TRIES = 6.0, 13.1, 14.9, 6.0, 4.0, 12


def anchors(labels: DataFrame, parts: DataFrame, scene: str) -> DataFrame:
    """``labels`` (id, seq, of, side, px, py) with the point (x, y) they stand at: their own (px, py) or one beside the part they name; null if there is no such part.

    ``parts`` has (id, x0, y0, x1, y1): a part's box, y downward.
    """
    box = parts.select(scene, F.col("id").alias("of"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    middle_x, middle_y = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2
    side = F.coalesce("side", F.lit("above"))
    x = F.when(side == "left", F.col("_x0") - GAP).when(side == "right", F.col("_x1") + GAP).otherwise(middle_x)
    y = F.when(side == "above", F.col("_y0") - GAP).when(side == "below", F.col("_y1") + HEIGHT).when(side.isin("left", "right", "center"), middle_y + 4).otherwise(middle_y)
    own = F.col("px").isNotNull() & F.col("py").isNotNull()
    return labels.join(box, [scene, "of"], "left").select(labels["*"], F.when(own, F.col("px")).otherwise(x).alias("x"), F.when(own, F.col("py")).otherwise(y).alias("y"))


def settle_labels(labels: DataFrame, parts: DataFrame, scene: str) -> DataFrame:
    """(scene, id, x, y, outcome) of labels (id, seq, text, of, side, anchor, px, py), each moved until it covers none placed before.

    A label ``above`` its part moves up, others down, :data:`TRIES` times at most; one that finds no room keeps its last place, where others avoid it, too, and is ``crowded``. A label without a part
    is ``lost`` and takes no room. Boxes are alike in height, so those that a label can meet are neighbours by y.
    """
    text = F.coalesce("text", F.lit(""))
    wide = F.char_length(F.regexp_replace(text, "[\u0000-⹿]", ""))
    some = anchors(labels, parts, scene).withColumn("w", wide * WIDE + (F.char_length(text) - wide) * NARROW)
    some = some.withColumn("left", F.col("x") - F.when(F.coalesce("anchor", F.lit("middle")) == "middle", F.col("w") / 2).when(F.col("anchor") == "end", F.col("w")).otherwise(0.0))
    some = some.withColumn("step", F.when(F.col("side") == "above", -STEP).otherwise(STEP))

    def each(own: Iterator[tuple]) -> Iterator[tuple]:
        placed: list[tuple[float, float, float]] = []  # (top, left, right), by top

        def free(top: float, left: float, right: float) -> bool:
            near = placed[bisect_left(placed, (top - HEIGHT,)) : bisect_right(placed, (top + HEIGHT,))]
            return all(right <= low or high <= left or top + HEIGHT <= t or t + HEIGHT <= top for t, low, high in near)

        for i, x, y, left, w, step in own:
            if x is None or y is None:
                yield i, None, None, "lost"
                continue
            tries = 0
            while tries < TRIES and not free(y - HEIGHT * 0.78, left, left + w):
                tries, y = tries + 1, y + step
            insort(placed, (y - HEIGHT * 0.78, left, left + w))
            yield i, x, y, "crowded" if tries == TRIES else "placed"

    return streamed(some, scene, ["seq", "id"], ["id", "x", "y", "left", "w", "step"], each, f"id {dict(labels.dtypes)['id']}, x double, y double, outcome string")
