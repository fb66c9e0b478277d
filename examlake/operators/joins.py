"""Joins of the assessment model: nearest, set-comparing, conflict-reporting, anti and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphan_objects(assets: DataFrame, targets: DataFrame, obj: str, owner: str) -> DataFrame:
    """Objects that the targets refer to and nobody else does; one aggregation instead of a NOT IN."""
    marked = assets.join(targets.select(owner).distinct().withColumn("_t", F.lit(True)), owner, "left")
    return marked.groupBy(obj).agg(F.bool_and(F.coalesce("_t", F.lit(False))).alias("_all")).where("_all").select(obj)


def latest_nonempty(parents: DataFrame, sheets: DataFrame, answers: DataFrame) -> DataFrame:
    """Each paper's newest sheet with an answer, later id first among equals; null where there is none."""
    found = sheets.join(answers.select("sheet_id").distinct(), "sheet_id", "left_semi").groupBy("paper_id").agg(F.max(F.struct("created_at", "sheet_id"))["sheet_id"].alias("latest_sheet"))
    return parents.join(found, "paper_id", "left").select("paper_id", "latest_sheet")


def failures(answers: DataFrame, sheets: DataFrame, papers: DataFrame, same: str) -> DataFrame:
    """Answers with the paper that their sheet belongs to, of the papers given, and ``n_same``, how many of them hang on the same thing."""
    own = answers.join(sheets.select("sheet_id", "paper_id"), "sheet_id").join(papers, "paper_id")
    return own.join(own.groupBy(same).agg(F.count("*").alias("n_same")), same)


def as_of(rows: DataFrame, marks: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """The nearest mark at or before each row, by one ordered pass over both.

    ``rows`` has ``by`` and ``at`` and more; ``marks`` has ``by``, ``at`` and ``value``. A window needs one key's rows in
    order, as any nearest join does; keys should be many.
    """
    both = rows.withColumn("_mark", F.lit(1)).unionByName(marks.select(*by, at, value).withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    line = Window.partitionBy(*by).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("_mark") == 0, F.col(value)), ignorenulls=True).over(line)).where("_mark = 1").drop("_mark")


def inside(points: DataFrame, boxes: DataFrame, by: Sequence[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Points in half-open intervals. Intervals are cut into cells of ``width``, so the join has an equality."""
    cell = lambda c: F.floor(c / width).cast("long")
    cells = boxes.where(F.col(high) > F.col(low)).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high) - 1))))
    return points.withColumn("_cell", cell(F.col(at))).join(cells, [*by, "_cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def locate(flow: DataFrame, points: DataFrame, by: Sequence[str], start: str, ok: str, fields: Sequence[str]) -> DataFrame:
    """Each offset with fields of the block it falls into, or beyond the last block, of that one.

    Blocks stand end to end, by where they begin; empty ones hold no offset. One that is not ``ok`` gives way to the next
    that is, then to the one before, and stands for itself where none is.
    """
    line = Window.partitionBy(*by).orderBy(start)
    own = F.struct(*fields)
    good = F.when(F.col(ok), own)
    after = F.first(good, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(good, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    found = as_of(points, flow.select(*by, start, F.coalesce(after, before, own).alias("_block")), by, start, "_block")
    return found.select(*points.columns, *[F.col(f"_block.{f}").alias(f) for f in fields])


def alias_dimension(vocabulary: DataFrame, code: str, name: str, aliases: Column) -> DataFrame:
    """(alias, code): a code, its name and its other names, all exact."""
    return vocabulary.select(F.col(code), F.explode(F.array_distinct(F.concat(F.array(F.col(code).cast("string"), F.col(name)), aliases))).alias("alias"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Parents with their children as one ordered text, ``field:field`` joined by ``|``."""
    item = F.concat_ws(":", *[F.col(f).cast("string") for f in fields])
    per = children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("_i")))), lambda x: x["_i"]), "|").alias("items"))
    return parents.join(per, key, "left").withColumn("items", F.coalesce("items", F.lit("")))


def missing(parents: DataFrame, satellite: DataFrame, key: str, must: Column) -> DataFrame:
    """How many parents lack what they must have, a missing satellite counted too."""
    return parents.join(satellite, key, "left").agg(F.count_if(F.coalesce(must, F.lit(True))).alias("n_missing"), F.count("*").alias("n"))
