"""Papers published again: their questions replaced by number, what hangs on those that stay is kept, children are replaced.

Tables are keyed by paper (``name``) and question (``name``, ``n``). Everything is joins over all papers that are published at once; papers that are not stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refused(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name): published papers that are there in the other mode, with reference answers alone: their answers would be lost."""
    return new.select("name").distinct().join(old.where("source_kind = 'answers_only'").select("name"), "name", "left_semi")


def next_papers(old: DataFrame, new: DataFrame, counts: DataFrame, as_of: Column, owner: Column) -> DataFrame:
    """Papers after a publish: (name, source_kind, source, n_questions, owner_id, created_at, updated_at, run_started_at).

    ``new`` has (name, source). A paper that is new begins now; one that has an owner keeps it.
    """
    columns = ["name", "source_kind", "source", "n_questions", "owner_id", "created_at", "updated_at", "run_started_at"]
    fresh = new.select("name", F.col("source").alias("_source")).join(counts, "name", "left").withColumn("_new", F.lit(True))
    both = old.join(fresh, "name", "full")
    published = F.coalesce(F.col("_new"), F.lit(False))
    values = {
        "source_kind": F.coalesce("source_kind", F.lit("pdf")),
        "source": F.when(published, F.col("_source")).otherwise(F.col("source")),
        "n_questions": F.when(published, F.coalesce("_n", F.lit(0))).otherwise(F.col("n_questions")),
        "owner_id": F.when(published, F.coalesce(F.col("owner_id"), owner)).otherwise(F.col("owner_id")),
        "created_at": F.coalesce("created_at", as_of),
        "updated_at": F.when(published, as_of).otherwise(F.col("updated_at")),
        "run_started_at": F.when(published, as_of).otherwise(F.col("run_started_at")),
    }
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in columns])


def next_questions(old: DataFrame, new: DataFrame, papers: DataFrame, content: Sequence[str]) -> DataFrame:
    """Questions after a publish: content is the new one's, other columns stay with the number; numbers that are gone go."""
    other = [c for c in old.columns if c not in ("name", "n", *content)]
    published = papers.select("name").distinct()
    kept = old.select("name", "n", *other)
    made = new.select("name", "n", *content).join(kept, ["name", "n"], "left").select(*old.columns)
    return old.join(published, "name", "left_anti").unionByName(made)


def next_children(old: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """Children of questions after a publish: those of the papers alone that are published are replaced, by what they bring, be it nothing."""
    return old.join(papers.select("name").distinct(), "name", "left_anti").unionByName(new.select(*old.columns))


def next_satellites(old: DataFrame, questions: DataFrame) -> DataFrame:
    """What hangs on questions by number: it stays as long as its question does."""
    return old.join(questions.select("name", "n"), ["name", "n"], "left_semi")


def next_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets after a publish, by (name, rel_path): new ones take the place of old ones; none goes."""
    return old.join(new.select("name", "rel_path"), ["name", "rel_path"], "left_anti").unionByName(new.select(*old.columns))


def next_state(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], content: Sequence[str], as_of: Column, owner: Column, children: Sequence[str] = (), satellites: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All tables after a publish. ``new`` has papers, questions, children and assets; a paper without questions loses those it has."""
    papers = new["papers"]
    counts = new["questions"].groupBy("name").agg(F.count("*").alias("_n"))
    questions = next_questions(old["questions"], new["questions"], papers, content)
    return {
        "papers": next_papers(old["papers"], papers, counts, as_of, owner),
        "questions": questions,
        **{c: next_children(old[c], new[c], papers) for c in children},
        **{s: next_satellites(old[s], questions) for s in satellites},
        "assets": next_assets(old["assets"], new["assets"]),
    }
