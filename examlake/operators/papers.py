"""a paper's bar of stages, how far it is, and the whole paper as one nested row.

All inputs are tables over many papers, keyed by ``paper_id``; nothing is collected. What a paper lacks is an empty array, 0 or null. Failures count only while no work goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import answers_agree
from . import merge, sheets

_STAGES = ("ingest", "segment", "solve", "spec", "scene", "assemble")


def cells(papers: DataFrame, stage: Column, failed: Column, artifacts: Column) -> DataFrame:
    """(paper_id, mode, cells array<struct<position, cell, state>>): the bar of each paper's mode.

    ``papers`` has (paper_id, source_kind); ``stage`` is the stage's code or null, ``failed`` that of a failure, ``artifacts`` an array of the cells that left something.
    """
    some = papers.select("paper_id", sheets.mode_of(F.col("source_kind")).alias("mode"), stage.alias("_stage"), failed.alias("_failed"), artifacts.alias("_artifacts"))
    return some.select("paper_id", "mode", _bar(F.col("mode"), F.col("_stage"), F.col("_failed"), F.col("_artifacts")).alias("cells"))


def _bar(mode: Column, stage: Column, failed: Column, artifacts: Column) -> Column:
    done = F.coalesce(stage == "done", F.lit(False))
    paper, sheet = (sheets.cell_bar(m, stage, done, failed, artifacts) for m in sheets.MODES)
    return F.when(mode == "sheet", sheet).otherwise(paper)


def progress(papers: DataFrame, counts: DataFrame, jobs: DataFrame, as_of: Column, quiet: int = 180) -> DataFrame:
    """how far each paper is: stage, whether work goes on, what failed, the live job's step and pages, and the bar.

    ``counts`` has the columns that stages are told by, ``changed_at``, and ``scenes``; ``jobs`` (paper_id, job, live, error, error_stage, step, page_done, page_total). A job's
    error counts if it is the latest job, none is live, nothing changed within ``quiet`` seconds and the paper is not done. A paper without counts is left out.
    """
    last = jobs.groupBy("paper_id").agg(F.max_by(F.struct("error", "error_stage"), "job").alias("_last"), F.max_by(F.struct("step", "page_done", "page_total"), F.when(F.col("live"), F.col("job"))).alias("_live"), F.bool_or("live").alias("_busy"))
    mode = sheets.mode_of(F.col("source_kind"))
    staged = papers.join(counts, "paper_id").join(last, "paper_id", "left").withColumn("_s", F.when(mode == "sheet", sheets.sheet_stage()).otherwise(sheets.paper_stage()))
    recent = F.unix_timestamp(as_of) - F.unix_timestamp("changed_at") < quiet
    busy = F.coalesce(F.col("_busy"), F.lit(False)) | F.coalesce(recent, F.lit(False))
    over = busy | (F.col("_s.stage") == "done")
    told = staged.withColumn("busy", busy).withColumn("failed", F.when(~over, F.col("_last.error"))).withColumn("failed_stage", F.when(~over & F.col("_last.error").isNotNull(), F.col("_last.error_stage")))
    have = F.array_compact(F.array(F.when(F.col("scenes") > 0, "scene"), F.when(F.col("assembled_fresh"), "assemble")))
    whole = told.withColumn("mode", mode).withColumn("_have", have)
    return whole.withColumn("cells", _bar(F.col("mode"), F.col("_s.stage"), F.col("failed_stage"), F.col("_have"))).select(
        "paper_id", "mode", F.col("_s.stage").alias("stage"), F.col("_s.done").alias("done"), F.col("_s.total").alias("total"), (F.col("_s.stage") == "done").alias("finished"), "busy", "failed", "failed_stage",
        F.col("_live.step").alias("step"), F.col("_live.page_done").alias("page_done"), F.col("_live.page_total").alias("page_total"), "cells",
    )


def _by_question(rows: DataFrame, order: str, name: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("paper_id", "n", order)]
    return rows.groupBy("paper_id", "n").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def question_view(questions: DataFrame, options: DataFrame, tables: DataFrame, solutions: DataFrame, failures: DataFrame, scenes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Questions with their options, tables put together, topics by name, solution, failure and scene, and whether the reference agrees with the
    solution's short answer (null if it cannot be told). A topic that the vocabulary lacks goes by its code.
    """
    united = merge.united_tables(tables, ["paper_id", "n"]).where(F.size("rows") > 0).drop("n_parts")
    codes = questions.select("paper_id", "n", F.posexplode("kps").alias("at", "kp")).select("paper_id", "n", "at", "kp.code", "kp.why").join(vocabulary, "code", "left")
    named = codes.select("paper_id", "n", "at", "code", F.coalesce("why", F.lit("")).alias("why"), F.coalesce("name", "code").alias("name"), F.coalesce("chapter", F.lit("")).alias("chapter"))
    one = lambda rows, name: rows.select("paper_id", "n", F.struct(*[c for c in rows.columns if c not in ("paper_id", "n")]).alias(name))
    out = questions.drop("kps")
    for rows, order, name in ((options, "ord", "options"), (united, "id", "tables"), (named, "at", "topics")):
        nested = _by_question(rows, order, name)
        out = out.join(nested, ["paper_id", "n"], "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    for rows, name in ((solutions, "solution"), (failures, "failure"), (scenes, "scene")):
        out = out.join(one(rows, name), ["paper_id", "n"], "left")
    return out.withColumn("agrees", answers_agree(F.col("ref_answer"), F.col("solution.short_answer")))


def paper_view(papers: DataFrame, questions: DataFrame, sheet_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """a row per paper: its questions in order, what was left by each stage and why not by the last, the bar, sheets of sheet papers, the live job, and
    how many questions are solved and failed of how many.

    ``papers`` has (paper_id, source_kind, sections, warnings, assembled_at, on_disk, changed_at), ``questions`` the rows of :func:`question_view`. An assembled page counts if it is there and no older than
    the paper's last change.
    """
    there = lambda c: F.count_if(F.col(c).isNotNull())
    own = questions.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("n", *[c for c in questions.columns if c not in ("paper_id", "n")]))).alias("questions"), F.count("*").alias("total"), there("solution").alias("solved"), there("failure").alias("failed"), there("scene").alias("scenes"),
        F.bool_or(F.coalesce(F.col("solution.spec_status"), F.lit("")) != "").alias("_specs"), F.bool_and(F.size("topics") > 0).alias("_topics"),
    )
    nested_sheets = sheet_rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("sheet_id", *[c for c in sheet_rows.columns if c not in ("paper_id", "sheet_id")]))).alias("sheets"))
    live = jobs.where("live").groupBy("paper_id").agg(F.max("job").alias("job"))
    both = papers.join(own, "paper_id", "left").na.fill(0, ["total", "solved", "failed", "scenes"]).join(nested_sheets, "paper_id", "left").join(live, "paper_id", "left")
    fresh = F.coalesce(F.col("assembled_at") >= F.col("changed_at"), F.lit(False))
    note = F.when(F.col("assembled_at").isNull(), "not assembled").when(~F.col("on_disk"), "page is gone").when(~fresh, "page is stale").otherwise("page is fresh")
    true = lambda c: F.coalesce(c, F.lit(False))
    left = {"ingest": F.lit(True), "segment": F.lit(True), "solve": F.col("solved") > 0, "spec": true(F.col("_specs")), "scene": F.col("scenes") > 0, "assemble": note == "page is fresh"}
    of_sheet = F.array(F.when(F.col("total") > 0, "refread"), F.when((F.col("total") > 0) & true(F.col("_topics")), "kpmark"))
    have = F.array_compact(F.when(sheets.mode_of(F.col("source_kind")) == "sheet", of_sheet).otherwise(F.array(*[F.when(left[s], s) for s in _STAGES])))
    none = F.lit(None).cast("string")
    whole = both.withColumn("mode", sheets.mode_of(F.col("source_kind"))).withColumn("_have", have)
    return whole.withColumn("cells", _bar(F.col("mode"), none, none, F.col("_have"))).select(
        "paper_id", "mode", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "questions", F.struct(*[left[s].alias(s) for s in _STAGES]).alias("stages"), note.alias("assemble_note"), "cells",
        F.when(F.col("mode") == "sheet", F.col("sheets")).alias("sheets"), "job", F.struct("solved", "failed", "total").alias("coverage"),
    )
