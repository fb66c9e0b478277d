"""Lookups and documents put together: one fact about one key, and everything about one paper."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owner_of(papers: DataFrame, name: str) -> DataFrame:
    """Whether a name exists, and who owns it, as two facts."""
    return papers.where(F.col("name") == name).agg((F.count("*") > 0).alias("found"), F.max("owner_id").alias("owner_id"))


def by_paper(rows: DataFrame, papers: DataFrame, name: str, columns: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Columns of the rows of a named paper; a null condition does not hold."""
    own = rows.join(papers.where(F.col("name") == name).select("paper_id"), "paper_id", "left_semi")
    return (own if condition is None else own.where(condition)).select(*columns)


def with_question(satellite: DataFrame, questions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of a satellite with fields of their question."""
    return satellite.join(questions.select(key, *fields), key)


def tallies(rows: DataFrame, outcome: Column) -> DataFrame:
    """Rows by outcome."""
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def child_count(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each parent with its number of children, 0 without any."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias("_n")), key, "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_n")


def sheet_detail(answers: DataFrame, questions: DataFrame, vocabulary: DataFrame, codes: str) -> DataFrame:
    """Answers with their question and the names of its codes, known ones alone, in the question's order."""
    named = questions.select("question_id", F.posexplode_outer(codes).alias("_i", "code")).join(vocabulary, "code", "left").where("name IS NOT NULL")
    per = named.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "name"))), lambda x: x["name"]).alias("topics"))
    return answers.join(questions.drop(codes), "question_id", "left").join(per, "question_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def paper_document(paper: DataFrame, questions: DataFrame, sheets: DataFrame, progress: DataFrame) -> DataFrame:
    """one nested row per paper: its questions and sheets in order, and its progress."""
    nest = lambda rows, order, name: rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in ("paper_id", order)]))).alias(name))
    return paper.join(nest(questions, "n", "questions"), "paper_id", "left").join(nest(sheets, "sheet_id", "sheets"), "paper_id", "left").join(progress.select("paper_id", F.struct(*[c for c in progress.columns if c != "paper_id"]).alias("progress")), "paper_id", "left")


def resume_gate(exists: Column, busy: Column, done: Column) -> Column:
    """the code that refuses to go on, null if nothing does."""
    return F.when(~exists, 404).when(busy, 409).when(done, 409)


def failure_note(error: Column, busy: Column, done: Column) -> Column:
    """an error's text, unless work goes on or has been done since."""
    return F.when(~busy & ~done, error)


def running_commands(commands: DataFrame, text: str, name: str) -> DataFrame:
    """ST12: the questions that running commands of a paper work on, and whether one works on the whole paper."""
    own = commands.where(F.contains(F.col(text), F.lit(f"--paper {name}")))
    only = F.regexp_extract(text, r"--only (\d+(?:,\d+)*)", 1)
    return own.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(only, ","), lambda x: x != ""))))).alias("questions"), F.coalesce(F.bool_or(only == ""), F.lit(False)).alias("whole"))


def intruders(elements: DataFrame, text: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Elements of markup with a pair of coordinates inside a rectangle."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?[ ,]\s*-?\d+(?:\.\d+)?)"), F.lit(1))
    point = lambda p, k: F.element_at(F.split(p, r"[ ,]\s*"), k).cast("double")
    return elements.where(F.exists(pairs, lambda p: point(p, 1).between(x0, x1) & point(p, 2).between(y0, y1)))


def free_names(bases: DataFrame, taken: DataFrame, base: str, number: str) -> DataFrame:
    """For each base the smallest number from 2 that is not taken: (base, number). The first gap among its own numbers, so none is tried."""
    own = taken.where(F.col(number) >= 2).select(base, number).distinct()
    line = Window.partitionBy(base).orderBy(number)
    # without a gap the k-th number is k + 1
    gap = own.withColumn("_k", F.row_number().over(line) + 1).groupBy(base).agg(F.min(F.when(F.col(number) > F.col("_k"), F.col("_k"))).alias("_gap"), (F.count("*") + 2).alias("_end"))
    return bases.select(base).distinct().join(gap, base, "left").select(base, F.coalesce("_gap", "_end", F.lit(2)).cast("int").alias(number))


def reading_order(runs: DataFrame, page: str, tolerance: float = 3.0) -> DataFrame:
    """W4, for pages of plain lines: lines are islands of runs whose baselines are near each other, read left to right."""
    line = Window.partitionBy(page).orderBy(F.desc("y"), "x")
    begun = runs.withColumn("_new", F.when(F.coalesce(F.lag("y").over(line) - F.col("y") <= tolerance, F.lit(False)), 0).otherwise(1))
    rows = begun.withColumn("line", F.sum("_new").over(line)).drop("_new")
    return rows.withColumn("order", F.row_number().over(Window.partitionBy(page).orderBy("line", "x", F.desc("y"))))


def list_papers(papers: DataFrame, children: Mapping[str, DataFrame], key: str, updated: Sequence[Column]) -> DataFrame:
    """Papers with the number of rows of each child table, 0 without any, and the latest of some times.

    ``updated`` are aggregates over the first child table. Each child is counted before it is joined.
    """
    out = papers
    for i, (name, child) in enumerate(children.items()):
        per = child.groupBy(key).agg(F.count("*").alias(name), *([F.greatest(*updated, updated[0]).alias("updated_at")] if i == 0 and updated else []))
        out = out.join(per, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def stat(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A4: the number of rows of each table."""
    each = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()]
    return reduce(DataFrame.unionAll, each)


def freshness(assembled: Column, *parts: Column) -> Column:
    """struct<changed, fresh>: the latest change of any part, nulls passed over, and whether it is not after assembly."""
    changed = F.greatest(*parts)
    return F.struct(changed.alias("changed"), (assembled >= changed).alias("fresh"))


def section_stats(rows: DataFrame, section: Column, kind: Column, points: str) -> DataFrame:
    """Questions, points and minutes (three quarters of the points, rounded) by section, or by type where there is none."""
    return rows.groupBy(F.coalesce(section, kind, F.lit("...")).alias("section")).agg(F.count("*").alias("n"), F.sum(points).alias("points"), F.round(F.sum(points) * 0.75).cast("long").alias("minutes"))


def chapters(chapters: DataFrame, entries: DataFrame, chapter: str, entry: str, order: Sequence[str]) -> DataFrame:
    """Entries per chapter with the chapter's place in a given order, 0 for others; chapters without entries count 0."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(chapter))
    return chapters.join(entries.groupBy(chapter).agg(F.count(entry).alias("_n")), chapter, "left").select(chapter, F.coalesce("_n", F.lit(0)).alias("n"), at.alias("position"))


def seam(rows: DataFrame, by: str, order: str, value: str, drop: float = 40.0) -> DataFrame:
    """The lowest value of the middle third, the first at a tie, and whether it is a seam: so far below the median."""
    whole = Window.partitionBy(by)
    k, n = F.row_number().over(whole.orderBy(order)), F.count("*").over(whole)
    third = rows.withColumn("_in", (k * 3 > n) & (k * 3 <= 2 * n))
    per = third.groupBy(by).agg(F.min(F.when(F.col("_in"), F.struct(value, order))).alias("_m"), F.median(value).alias("median"))
    return per.select(by, F.col(f"_m.{order}").alias("at"), "median", (F.col("median") - F.col(f"_m.{value}") >= drop).alias("seam"))


def band_contrast(rows: DataFrame, by: str, inside: Column, value: str) -> DataFrame:
    """Mean inside a band less mean outside, 0 where nothing is outside."""
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    return rows.groupBy(by).agg(F.coalesce(mean(inside) - mean(~inside), F.lit(0.0)).alias("contrast"))


def with_latest(parents: DataFrame, satellites: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each parent with fields of its latest satellite, null without one."""
    last = satellites.groupBy(key).agg(F.max(F.struct(*order, *[f for f in fields if f not in order])).alias("_s"))
    return parents.join(last, key, "left").select(*parents.columns, *[F.col(f"_s.{f}").alias(f) for f in fields])


def fresh_rows(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted rows that are stored under the same keys and digests."""
    return wanted.join(stored.select(*keys), list(keys), "left_semi")


def filter_counts(rows: DataFrame, by: str, filters: Mapping[str, Column]) -> DataFrame:
    """How many rows each named filter lets through, all in one pass."""
    return rows.groupBy(by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in filters.items()])


def landing(sheets: DataFrame, answers: DataFrame, by: str, key: str, order: Sequence[Column]) -> DataFrame:
    """K5: each parent's first sheet with an answer, in a given order."""
    some = sheets.join(answers.select(key).distinct(), key, "left_semi")
    return some.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_k = 1").select(by, key)


def each_once(rows: DataFrame, inputs: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``value``, which costs much, computed once for each distinct row of its ``inputs``.

    The distinct rows are few bytes and much work, so they are dealt over all cores.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    told = rows.select(*inputs).distinct().repartition(tasks, *inputs).select(*[F.col(c).alias(f"_{c}") for c in inputs], value.alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in inputs])
    return rows.join(told, same).drop(*[f"_{c}" for c in inputs])
