"""Cutting a text into questions: detectors of anchors, a score of how well anchors fit the text, and what is wrong with a cut.

Anchors are rows (key, pos, end, type, points), places in the text of their key; documents are rows (key, text, length,
declared), the last the number of questions that the text itself declares, null if it does not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .folds import with_upper_median

# fixed values: words for the type of a question
TYPE_WORDS = ("单选题", "多选题", "填空题", "实验题", "计算题", "解答题", "作图题", "论述题", "简答题", "综合题")
# a type word is sought by its last character, which all have in common, and a number by its first digit; then one looks back
_TYPES = re.compile(f"题(?<=({'|'.join(TYPE_WORDS)}))")
_COMMA = re.compile("[、，]")
_SPACE = r" \t\n\x0b\f\r"
_POINTS = re.compile(rf"[{_SPACE}]*[（(]([0-9]+)分[)）]")
_ARABIC = re.compile(rf"([0-9](?<![^{_SPACE}\u3000\xa0][0-9])[0-9]?)[{_SPACE}]*[.．、]")

_SCHEMES = ("type words with points", "type words", "arabic numbers")
_ANCHOR = "scheme string, pos int, end int, type string, points int"


def _int(digits: str) -> int | None:
    """The number, null where no int holds it."""
    short = digits.lstrip("0")
    return int(short or "0") if len(short) < 10 or (len(short) == 10 and short <= "2147483647") else None


def _anchors(text: str, least: int) -> list[tuple]:
    """Anchors of three schemes: type words with points and type words alone, none that follows a comma within three characters,
    which heads a section; and numbers that begin lines or words, as far as they run 1, 2, 3, ... in order, ``least`` of them at
    least."""
    words = [(*w.span(1), w[1]) for w in _TYPES.finditer(text)]
    words = [w for w in words if not _COMMA.search(text, max(w[0] - 3, 0), w[0])]
    out = [(_SCHEMES[0], at, p.end(), word, _int(p[1])) for at, end, word in words if (p := _POINTS.match(text, end))]
    out += [(_SCHEMES[1], at, end, word, None) for at, end, word in words]
    kept: list[tuple] = []
    for m in _ARABIC.finditer(text):
        if int(m[1]) == len(kept) + 1:
            kept.append((_SCHEMES[2], m.start(), m.end(), None, None))
    return out + kept if len(kept) >= least else out


@lru_cache
def _anchors_of_texts(least: int) -> Callable:
    made = to_arrow_schema(StructType.fromDDL(_ANCHOR))

    def run(texts: pa.Array) -> pa.Array:
        each = [[] if (text := t.as_py()) is None else _anchors(text, least) for t in texts]
        flat = [a for own in each for a in own]
        anchors = pa.StructArray.from_arrays([pa.array([a[i] for a in flat], f.type) for i, f in enumerate(made)], fields=list(made))
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, each), initial=0), pa.int32()), anchors)

    return F.arrow_udf(run, ArrayType(StructType.fromDDL(_ANCHOR)))


def _with_anchors(docs: DataFrame, key: str, least: int) -> DataFrame:
    """(key, scheme, pos, end, type, points, length, declared): a document's anchors, all of them null where it has none."""
    every = _anchors_of_texts(least)(F.col("text"))
    return docs.select(key, "length", "declared", F.explode_outer(every).alias("a")).select(key, "a.*", "length", "declared")


def text_anchors(docs: DataFrame, key: str, least: int = 4) -> DataFrame:
    """The anchors of all schemes that go by the text, in one pass over it: (key, scheme, pos, end, type, points, length, declared)."""
    return _with_anchors(docs, key, least).where(F.col("scheme").isNotNull())


def type_word_anchors(docs: DataFrame, key: str) -> DataFrame:
    """The anchors at type words alone, with and without points."""
    return text_anchors(docs, key).where(F.col("scheme").startswith("type words")).drop("length", "declared")


def arabic_anchors(docs: DataFrame, key: str, least: int = 4) -> DataFrame:
    """The anchors at numbers alone."""
    return text_anchors(docs, key, least).where("scheme = 'arabic numbers'").drop("length", "declared")


def typography_anchors(flow: DataFrame, key: str, least: int = 5, most: int = 3) -> DataFrame:
    """Lines after a gap of 1.6 times the upper median, by size and left margin; the largest groups, the first at a tie.

    ``flow`` has (key, seq, page, x, y, size, start, end), lines that count alone; y grows upward.
    """
    page = Window.partitionBy(key)
    line, group = page.orderBy("seq"), Window.partitionBy(key, "_size", "_left")
    gap = F.when(F.lag("page").over(line) == F.col("page"), F.lag("y").over(line) - F.col("y"))
    marks = flow.withColumn("_gap", gap).withColumn("_n", F.count("*").over(page)).where("_n >= 8")
    # all windows are within a key, so its lines are dealt once
    middle = with_upper_median(marks, key, F.when(F.col("_gap") > 0, F.col("_gap")), "_m").withColumn("_m", F.max("_m").over(page))
    head = middle.where(F.col("_gap") >= 1.6 * F.col("_m")).withColumn("_size", F.bround("size", 1)).withColumn("_left", (F.rint(F.col("x") / 6) * 6).cast("int"))
    groups = head.withColumn("_k", F.count("*").over(group)).withColumn("_first", F.min("seq").over(group)).where(F.col("_k") >= least)
    best = groups.withColumn("_r", F.dense_rank().over(page.orderBy(F.desc("_k"), "_first", "_size", "_left"))).where(F.col("_r") <= most)
    # a null key is left out by what no scan can take up: a document's lines and its flow may then be dealt as one
    name = F.when(F.col(key).isNotNull(), F.concat(F.lit("typography "), F.format_number("_size", 1), F.lit("/"), F.col("_left").cast("string")))
    return best.where(name.isNotNull()).select(key, name.alias("scheme"), F.col("start").alias("pos"), "end", F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("points"))


def anchor_score(anchors: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, median, tiny, coverage, score, confident, why): how well anchors fit their text.

    Taken or added: 12 for each question more or less than declared; the middle length, up to 2; 8 for each piece below 25; the
    distance from one question in 300 characters, weakly where a number is declared; unevenness; coverage, and 15 below 0.4;
    25 outside 4 to 60 questions; a little for types and points, 4 where types are lacking. ``why`` is the first thing
    that makes the cut unsafe: ``fragments``, ``coverage``, ``declared`` or ``length``. ``docs`` has the first of ``keys``.
    """
    return _scored(anchors.join(docs.select(keys[0], "length", "declared"), keys[0]), keys)


def _scored(at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`anchor_score` of anchors that have ``length`` and ``declared``."""
    line = Window.partitionBy(*keys).orderBy("pos")
    seg = F.greatest(F.lit(0), F.coalesce(F.lead("pos").over(line), F.col("length")) - F.col("end"))
    cv = F.coalesce(F.try_divide(F.stddev_pop("_seg"), F.avg("_seg")), F.lit(0.0))
    median = F.max("_middle").cast("int")
    per = with_upper_median(at.withColumn("_seg", seg), keys, F.col("_seg"), "_middle").groupBy(*keys).agg(
        F.count("*").alias("n"), median.alias("median"), F.count_if(F.col("_seg") < 25).alias("tiny"), cv.alias("_cv"), ((F.max("pos") - F.min("pos")) / F.greatest(F.max("length"), F.lit(1))).alias("coverage"),
        F.max("length").alias("_length"), F.max("declared").alias("_declared"), F.bool_and(F.coalesce(F.col("type"), F.lit("")) != "").alias("_typed"), F.bool_and(F.col("points").isNotNull()).alias("_pointed"),
    )
    n, declared, expected = F.col("n"), F.coalesce("_declared", F.lit(0)), F.col("_length") / 300.0
    known = declared != 0
    score = (
        -12.0 * F.when(known, F.abs(n - declared)).otherwise(0) + F.least("median", F.lit(300)) / 150.0 - 8.0 * F.col("tiny") - F.abs(n - expected) * F.when(known, 0.15).otherwise(0.8)
        - 2.0 * F.least("_cv", F.lit(3.0)) + 6.0 * F.col("coverage") - F.when(F.col("coverage") < 0.4, 15).otherwise(0) - F.when(n.between(4, 60), 0).otherwise(25)
        + F.when(F.col("_typed"), 0.3).otherwise(-4.0) + F.when(F.col("_pointed"), 0.5).otherwise(0.0)
    )
    why = F.when(F.col("tiny") > 0, "fragments").when(F.col("coverage") < 0.6, "coverage").when(known & (n != declared), "declared").when(~known & ~n.between(expected * 0.5, expected * 2.0), "length")
    return per.select(*keys, "n", "median", "tiny", "coverage", score.alias("score"), why.isNull().alias("confident"), why.alias("why"))


def detect(docs: DataFrame, flow: DataFrame | None, key: str) -> DataFrame:
    """(key, scheme, n, score, confident, why) of the scheme of anchors that fits best, by the order of detectors at a tie:
    type words, numbers, typography."""
    found = _with_anchors(docs, key, 4).withColumn("_known", F.lit(True))
    if flow is not None:
        # every document has a row, so what is known of it comes to the anchors of its flow without a join, in the order that scores need
        whole = Window.partitionBy(key).orderBy("scheme", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        both = found.unionByName(typography_anchors(flow, key), allowMissingColumns=True)
        found = both.withColumns({c: F.max(c).over(whole) for c in ("length", "declared", "_known")})
    scored = _scored(found.where("_known AND scheme IS NOT NULL"), [key, "scheme"])
    rank = F.when(F.col("scheme") == "type words with points", 0).when(F.col("scheme") == "type words", 1).when(F.col("scheme") == "arabic numbers", 2).otherwise(3)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), rank, "scheme"))
    return scored.withColumn("_k", best).where("_k = 1").select(key, "scheme", "n", "score", "confident", "why")


def cut_warnings(sections: DataFrame, questions: DataFrame, assigned: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, kind, what, n): what is wrong with a cut.

    ``section``: not as many questions as a section declares; ``short``: under 20 characters; ``options``: a choice question
    without four; ``shared``: a figure given to several questions; ``orphan``: one given to none; ``degraded``: text that
    cannot be used. ``sections`` (key, label, declared), ``questions`` (key, n, section, n_chars, type, n_options,
    quality), ``assigned`` (key, figure, n), ``figures`` (key, figure).
    """
    row = lambda kind, what, n: [key, F.lit(kind).alias("kind"), what.cast("string").alias("what"), n.cast("long").alias("n")]
    got = questions.groupBy(key, F.col("section").alias("label")).agg(F.count("*").alias("_got"))
    counted = sections.join(got, [key, "label"], "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    out = counted.where("_got <> declared").select(*row("section", F.col("label"), F.col("_got")))
    faults = F.array_compact(F.array(
        F.when(F.col("n_chars") < 20, F.struct(F.lit("short").alias("k"), F.col("n_chars").cast("long").alias("v"))),
        F.when(F.col("type").isin("单选题", "多选题") & (F.col("n_options") != 4), F.struct(F.lit("options").alias("k"), F.col("n_options").cast("long").alias("v"))),
        F.when(F.col("quality") == "degraded", F.struct(F.lit("degraded").alias("k"), F.lit(None).cast("long").alias("v"))),
    ))
    each = questions.select(key, "n", F.explode(faults).alias("f"))
    out = out.unionByName(each.select(key, F.col("f.k").alias("kind"), F.col("n").cast("string").alias("what"), F.col("f.v").alias("n")))
    per = assigned.groupBy(key, "figure").agg(F.count("*").alias("_k"))
    out = out.unionByName(per.where("_k > 1").select(*row("shared", F.col("figure"), F.col("_k"))))
    return out.unionByName(figures.select(key, "figure").join(assigned.select(key, "figure"), [key, "figure"], "left_anti").select(*row("orphan", F.col("figure"), F.lit(None))))


def longest_run(rows: DataFrame, by: str, order: str, value: str, flat: float = 1.0) -> DataFrame:
    """The longest consecutive run of rows whose value is above the middle between smallest and largest, the first at a tie;
    the whole where values differ by less than ``flat``."""
    whole = Window.partitionBy(by)
    high, low = F.max(value).over(whole), F.min(value).over(whole)
    bright = rows.withColumn("on", (high - low < flat) | (F.col(value) > (high + low) / 2))
    line = Window.partitionBy(by).orderBy(order)
    run = F.row_number().over(line) - F.row_number().over(Window.partitionBy(by, "on").orderBy(order))
    runs = bright.withColumn("run", run).where("on").groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("length"), "first"))
    return runs.withColumn("k", best).where("k = 1").select(by, "first", "last", "length")
