"""Whether a vocabulary of topics holds together, before anything is named by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the chapters of the vocabulary, and what codes are made of
CHAPTERS = ("运动学", "相互作用与牛顿运动定律", "曲线运动与万有引力", "功和能", "动量", "机械振动与机械波", "静电场", "恒定电流", "磁场", "电磁感应", "交变电流", "热学", "光学", "近代物理", "实验与数据处理")
CODE = r"^[a-z0-9_.]+$"
REQUIRED = ("code", "chapter", "name")


def problems(entries: DataFrame, order: str, chapters: tuple[str, ...] = CHAPTERS) -> DataFrame:
    """(order, problem, detail): ``lacks`` a required field, ``repeated`` code (all entries but the first), ``code`` with other characters, ``chapter``
    that is none, ``aliases`` that are no list.

    ``entries`` has code, chapter, name and aliases, the last as JSON text; null aliases are an empty list. A null code is lacking, and, from its second time
    on, repeated, too. Codes meet by a shuffle on them, so a vocabulary may be of any length.
    """
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "") == ""
    before = F.row_number().over(Window.partitionBy("code").orderBy(order)) > 1
    told = lambda test, problem, detail: F.when(test, F.struct(F.lit(problem).alias("problem"), detail.cast("string").alias("detail")))
    found = [told(blank(c), "lacks", F.lit(c)) for c in REQUIRED]
    found += [
        told(F.col("_again"), "repeated", F.col("code")),
        told((F.coalesce("code", F.lit("")) != "") & ~F.col("code").rlike(CODE), "code", F.col("code")),
        told(~F.coalesce(F.col("chapter").isin(*chapters), F.lit(False)), "chapter", F.col("chapter")),
        told(F.col("aliases").isNotNull() & F.json_array_length("aliases").isNull(), "aliases", F.col("aliases")),
    ]
    each = entries.withColumn("_again", before).select(order, F.explode(F.array_compact(F.array(*found))).alias("_p"))
    return each.select(order, "_p.problem", "_p.detail")


def index(entries: DataFrame) -> DataFrame:
    """(term, code): what an entry can be found by: its code, its name and its aliases, trimmed and in lower case; of a term that several have, the smallest code."""
    aliases = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    terms = entries.select("code", F.explode(F.concat(F.array("code", "name"), aliases)).alias("term")).select(F.lower(F.trim("term")).alias("term"), "code")
    return terms.where("term <> ''").groupBy("term").agg(F.min("code").alias("code"))
