"""How five filters interact: what each removes in every order, from the edges of the lattice of filter subsets.

A document is described by the set of filters it fails. An edge of the lattice is (filters already applied, next
filter), 80 for five filters; each document adds to the counts of all of them. Documents of one part with the same
failures and labels add alike, so they are counted first and added together. An order of the filters is a path of
five edges; the 120 orders are 600 steps, which are joined to the summed edges.

The filters: A too few words, B too few distinct words, C too many capitals, D one of some signs, E the whole text is
that of a smaller ``doc_id``.

What is shuffled: a document's id, digest of the text and failures (under 100 bytes, whatever its length), first for its
labels, then, summed up within tasks, by digest. A text that a third of all rows hold leaves each task a few
times at most: once for each part and pair of labels.

Defined cases: null text is the empty text, null ``lang`` the part ''; a null ``doc_id`` has no labels, is never E and
makes no other document E; rows with the same id and text are documents each, and not E through one another; of several labels
of an id the highest counts; an empty table has no parts and so no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE

FILTERS = "ABCDE"
_BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bits(names) -> int:
    return sum(_BIT[x] for x in names)


def edges() -> list[tuple[int, int, int]]:
    """(applied, next, orders): the 80 edges of the lattice, and how many of the 120 orders go through each."""
    return [(_bits(s), _BIT[f], factorial(len(s)) * factorial(len(FILTERS) - 1 - len(s))) for f in FILTERS for k in range(len(FILTERS)) for s in combinations(FILTERS.replace(f, ""), k)]


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, next): the 600 steps of all orders."""
    return [("".join(p), k + 1, _bits(p[:k]), _BIT[p[k]]) for p in permutations(FILTERS) for k in range(len(FILTERS))]


def text_failures(text: Column) -> dict[str, Column]:
    """Which of A to D a text fails; ``words`` must be its words."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails, n): rows alike are counted in ``n``; ``fails`` has the bits of A to D."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    each = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    each = each.withColumn("words", F.array_remove(F.split(F.translate("text", ASCII_SPACE, " " * len(ASCII_SPACE)), " "), ""))
    fails = sum((F.when(test, _BIT[name]).otherwise(0) for name, test in text_failures(F.col("text")).items()), F.lit(0))
    return each.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fails.alias("fails")).groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by all that they fail, E included, and by their labels."""
    flag = lambda name: F.max(F.coalesce(labels[name].cast("int") == 1, F.lit(False)))
    known = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("doc_id IS NOT NULL")
    labelled = described(docs).join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    same = labelled.groupBy("digest", "fails", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id")
    )
    # a digest has a row for each part and pair of labels here, however many documents hold the text
    same = same.withColumn("smallest", F.min("first").over(Window.partitionBy("digest")))
    fresh = F.col("n_no_id") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    split = same.select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails").alias("fails"), fresh.alias("n")), F.struct((F.col("fails") + _BIT["E"]).alias("fails"), (F.col("n") - fresh).alias("n")))).alias("x")
    )
    return split.where("x.n > 0").groupBy("part", F.col("x.fails").alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def edge_counts(counts: DataFrame) -> DataFrame:
    """(part, applied, next, counts..., shapley): each part's 80 edges; ``shapley`` belongs to the next filter."""
    lattice = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next"), F.lit(w).alias("orders")) for a, f, w in edges()))
    on = counts.withColumn("edge", F.explode(lattice)).select("part", "fails", "good", "toxic", "n", "edge.*")
    earlier, here = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("next")) != 0
    tests = dict(
        kept=~earlier & ~here, removed=~earlier & here, redundant=earlier & here, unique_fails=F.col("fails") == F.col("next"), good_lost=~earlier & here & F.col("good"), toxic_lost=~earlier & here & F.col("toxic")
    )
    summed = on.groupBy("part", "applied", "next", "orders").agg(*(F.sum(F.when(tests[c], F.col("n")).otherwise(0)).alias(c) for c in _COUNTS))
    return summed.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next"))).drop("orders")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) by part, order and step."""
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    return edge_counts(failure_counts(docs, labels)).join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *_COUNTS, "shapley")
