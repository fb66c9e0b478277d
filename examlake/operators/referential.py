"""Deletes over a set of related tables: what depends on a deleted row goes, too, or loses its key, as one set of changes.

A relation is (child, key columns of the child, parent, key columns of the parent, action): ``cascade`` deletes children, ``set null`` keeps them without the key.
Relations may form a chain, not a circle. Rows with a null in a key depend on nothing. No row comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Relation = tuple[str, Sequence[str], str, Sequence[str], str]


def dependants(children: DataFrame, fk: Sequence[str], doomed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``children`` that hang on ``doomed`` keys, each once however often a key is named."""
    return children.join(_keys(doomed, key, fk), list(fk), "left_semi").select(*children.columns)


def _keys(doomed: DataFrame, key: Sequence[str], fk: Sequence[str]) -> DataFrame:
    return doomed.select(*[F.col(k).alias(c) for k, c in zip(key, fk, strict=True)]).distinct()


def delete_rows(tables: Mapping[str, DataFrame], relations: Sequence[Relation], name: str, doomed: DataFrame, key: Sequence[str]) -> tuple[dict[str, DataFrame], dict[tuple[str, str], DataFrame]]:
    """(tables after the delete, changes): ``doomed`` has the keys of rows of ``name`` to go.

    Changes are by table and action (``delete`` or ``set null``), with the rows as they were.
    """
    after, changes = dict(tables), {}
    waiting = [(name, dependants(tables[name], key, doomed, key), key)]
    while waiting:
        parent, gone, own = waiting.pop(0)
        changes[parent, "delete"] = changes[parent, "delete"].unionByName(gone).distinct() if (parent, "delete") in changes else gone
        after[parent] = after[parent].join(_keys(gone, own, own), list(own), "left_anti").select(*after[parent].columns)
        for child, fk, of, pk, action in relations:
            if of != parent:
                continue
            hit = dependants(after[child], fk, gone, pk)
            if action == "cascade":
                waiting.append((child, hit, fk))
            else:
                changes[child, "set null"] = hit
                lost = _keys(gone, pk, fk).withColumn("_lost", F.lit(True))
                kept = [F.when(F.col("_lost"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fk else F.col(c) for c in after[child].columns]
                after[child] = after[child].join(lost, list(fk), "left").select(*kept)
    return after, changes


def drop_questions(papers: DataFrame, questions: DataFrame, answers: DataFrame, doomed: DataFrame, as_of: Column, satellites: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Questions (paper_id, n) go with their satellites; answers stay, without their question; each paper's number of questions is counted anew.

    ``answers`` has (paper_id, question) and its own key. The report has for each paper that was named (paper_id, questions, unbound_answers): how many
    questions went and how many answers lost theirs. Papers that were named and lost nothing are counted and stamped, too, those unknown are left out.
    """
    answers = answers.withColumn("_paper", F.when(F.col("question").isNotNull(), F.col("paper_id")))
    tables = {"questions": questions, "answers": answers, **(satellites or {})}
    relations: list[Relation] = [("answers", ["_paper", "question"], "questions", ["paper_id", "n"], "set null")]
    relations += [(s, ["paper_id", "n"], "questions", ["paper_id", "n"], "cascade") for s in satellites or {}]
    after, changes = delete_rows(tables, relations, "questions", doomed, ["paper_id", "n"])
    named = doomed.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_semi")
    count = lambda rows, label: rows.groupBy("paper_id").agg(F.count("*").alias(label))
    left = count(after["questions"], "_left")
    report = reduce(lambda a, b: a.join(b, "paper_id", "left"), [count(changes["questions", "delete"], "questions"), count(changes["answers", "set null"], "unbound_answers")], named).na.fill(0, ["questions", "unbound_answers"])
    counted = papers.join(named.withColumn("_named", F.lit(True)), "paper_id", "left").join(left, "paper_id", "left")
    fresh = {"n_questions": F.when(F.col("_named"), F.coalesce("_left", F.lit(0))).otherwise(F.col("n_questions")), "updated_at": F.when(F.col("_named"), as_of).otherwise(F.col("updated_at"))}
    after["papers"] = counted.select(*[fresh.get(c, F.col(c)).alias(c) for c in papers.columns])
    after["answers"] = after["answers"].drop("_paper")
    return after, report
