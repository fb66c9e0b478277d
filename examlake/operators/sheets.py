"""Answer sheets: numbers bound to the reference, readings merged, points checked, verdicts overridden, papers and their stage.

A question's number is a whole one below 100, or ``main * 100 + part``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def main_number(n: Column) -> Column:
    """The whole question that a number belongs to."""
    return F.when(n >= 100, F.floor(n / 100).cast("long")).otherwise(n.cast("long"))


def bind_kinds(rows: DataFrame, known: DataFrame, key: str, n: str) -> DataFrame:
    """(key, main, kind, have, want): each whole question of ``rows`` against the reference, as sets of numbers.

    ``bound``: the same; ``whole``: one block here, parts in the reference; ``missing``: some were not read; ``mismatch``:
    here is a number that the reference lacks; ``unknown``: the reference lacks the question.
    """
    per = lambda d, name: d.groupBy(key, main_number(F.col(n)).alias("main")).agg(F.array_sort(F.collect_set(F.col(n).cast("long"))).alias(name))
    both = per(rows, "have").join(per(known, "want"), [key, "main"], "left")
    kind = (
        F.when(F.col("want").isNull(), "unknown")
        .when(F.col("have") == F.col("want"), "bound")
        .when(F.col("have") == F.array("main"), "whole")
        .when(F.size(F.array_except("have", "want")) == 0, "missing")
        .otherwise("mismatch")
    )
    return both.select(key, "main", kind.alias("kind"), "have", "want")


def bind(rows: DataFrame, known: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with ``bind``, the number that a row is bound to, ``bind_main``, the whole question where only that fits,
    and ``kind``. Of a question whose numbers mismatch no row is bound."""
    kinds = bind_kinds(rows, known, key, n).select(key, F.col("main").alias("_main"), "kind")
    at = rows.withColumn("_main", main_number(F.col(n))).join(kinds, [key, "_main"])
    return at.withColumn("bind", F.when(F.col("kind").isin("bound", "missing"), F.col(n))).withColumn("bind_main", F.when(F.col("kind") == "whole", F.col("_main"))).drop("_main")


def spread(values: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """(n, value): a value for a known number is its own; one for a number that is not known goes to its known parts."""
    own = values.select("n", F.col(value).alias("_own"))
    whole = values.join(known.select("n"), "n", "left_anti").select(F.col("n").alias("_main"), F.col(value).alias("_whole"))
    part = F.when(F.col("n") >= 100, main_number(F.col("n")))
    both = known.select("n", part.alias("_main")).join(own, "n", "left").join(whole, "_main", "left")
    return both.select("n", F.coalesce("_own", "_whole").alias(value)).where(F.col(value).isNotNull())


def spread_extras(values: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers that are neither known nor the whole of known parts; they are dropped."""
    mains = known.where("n >= 100").select(main_number(F.col("n")).alias("n"))
    return values.select("n").join(known.select("n").unionByName(mains).distinct(), "n", "left_anti")


#: fixed values: what counts as not read
BLANKS, MARK_BLANKS = ("", "unreadable", "blank"), ("", "none", "unknown")


def merge_reads(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], marks: Sequence[str] = ("mark",)) -> DataFrame:
    """Two readings of the same rows, field by field: what was read, the first where both were; ``conflicts`` names the
    fields that both read and differ, ``only_second`` the rows that the first reading lacks. Blanks are no content."""
    x, y = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a")), b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields])
    both = x.join(y, list(keys), "full")

    def read(side: str, f: str) -> Column:
        blank = MARK_BLANKS if f in marks else BLANKS
        return F.when(~F.col(f"{side}_{f}").cast("string").isin(*blank), F.col(f"{side}_{f}"))

    clash = F.array_join(F.array_compact(F.array(*[F.when(read("a", f) != read("b", f), F.lit(f)) for f in fields])), ",")
    kept = [F.coalesce(read("a", f), read("b", f), F.col(f"a_{f}"), F.col(f"b_{f}")).alias(f) for f in fields]
    return both.select(*keys, *kept, clash.alias("conflicts"), F.col("_a").isNull().alias("only_second"))


def checksum(answers: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """The sum of the points that there are against the printed total: ``ok``, ``off``, or ``no total``, which passes, too;
    and how many answers have no points, which explain what is off."""
    per = answers.groupBy(key).agg(F.sum("score_got").alias("_got"), F.count_if(F.col("score_got").isNull()).alias("_unscored"))
    both = totals.join(per, key, "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    state = F.when(F.col("total").isNull(), "no total").when(F.abs(F.col("_got") - F.col("total")) < 0.01, "ok").otherwise("off")
    return both.select(key, F.col("_got").cast("double").alias("got"), F.col("total").cast("double").alias("total"), state.alias("state"), F.coalesce("_unscored", F.lit(0)).alias("unscored"))


def teacher_override(answers: DataFrame, verdict: Column, given: Column) -> DataFrame:
    """A teacher's verdict and score. The score is what is given, else the full one for right and none for wrong; partial
    without a score is an error; a null verdict takes both back."""
    score = F.coalesce(given.cast("decimal(18,4)"), F.when(verdict == "right", F.col("score_full").cast("decimal(18,4)")).when(verdict == "wrong", F.lit(0).cast("decimal(18,4)")))
    unknown = (verdict == "partial") & given.isNull()
    return answers.withColumn("teacher_verdict", verdict).withColumn("teacher_score_got", F.when(unknown, F.raise_error("a partial verdict needs a score")).when(verdict.isNotNull(), score))


def first_answer_all_solutions(rows: DataFrame, keys: Sequence[str], order: str, answer: str, solution: str) -> DataFrame:
    """Of repeated numbers the first answer counts; solutions are put one after another, in order.

    Rows without a number (the last of ``keys``) or without an answer are dropped; empty solutions are left out.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    some = rows.where(F.col(keys[-1]).isNotNull() & (text(answer) != "")).select(*keys, order, text(answer).alias("_a"), F.nullif(text(solution), F.lit("")).alias("_s"))
    per = some.groupBy(*keys).agg(F.min(F.struct(order, "_a", "_s"))["_a"].alias(answer), F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct(order, "_a", "_s")))).alias("_k"))
    return per.select(*keys, answer, F.nullif(F.array_join(F.transform("_k", lambda x: x["_s"]), " "), F.lit("")).alias(solution))


#: stages of a paper: code, whether it is open, how much is done and of how much; the first open one counts
_PAPER = [
    ("solve", "solutions + failures < questions", "solutions + failures", "questions"),
    ("outline", "labels < solutions", "labels", "solutions"),
    ("kpmark", "coalesce(kps_judged, kps, 0) < questions", "coalesce(kps_judged, kps, 0)", "questions"),
    ("pick", "judged < solutions", "judged", "solutions"),
    ("spec", "specs_worth < worth", "specs_worth", "worth"),
    ("check", "drafts > 0", "specs - drafts", "specs"),
    ("scene", "scene_tried < ready", "scene_tried", "ready"),
    ("assemble", "NOT assembled_fresh", "0", "1"),
]
_SHEET = [("refread", "questions = 0", "0", "1"), ("kpmark", "coalesce(kps_judged, kps, 0) < questions", "coalesce(kps_judged, kps, 0)", "questions")]


def _first_open(tests: Sequence[tuple[str, str, str, str]]) -> Column:
    out = F.struct(F.lit("done").alias("stage"), F.lit(1).cast("long").alias("done"), F.lit(1).cast("long").alias("total"))
    for code, open_, done, total in reversed(tests):
        out = F.when(F.expr(open_), F.struct(F.lit(code).alias("stage"), F.expr(done).cast("long").alias("done"), F.expr(total).cast("long").alias("total"))).otherwise(out)
    return out


def paper_stage() -> Column:
    """struct<stage, done, total> from the columns of progress; each stage has a total of its own."""
    return _first_open(_PAPER)


def sheet_stage() -> Column:
    """the same of a paper that has reference answers alone: reading them, then knowledge points."""
    return _first_open(_SHEET)


def mode_of(kind: Column) -> Column:
    """the mode of a source kind; unknown kinds and none are papers."""
    return F.when(kind == "answers_only", "sheet").otherwise("paper")


MODES = ("paper", "sheet")


def papers_with_stage(papers: DataFrame, progress: DataFrame, key: str, kind: str, mode: str | None = None) -> DataFrame:
    """papers with mode, stage, how far it is and whether all is done; of one mode, if one is asked for."""
    if mode is not None and mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    rows = papers.withColumn("mode", mode_of(F.col(kind)))
    if mode is not None:
        rows = rows.where(F.col("mode") == mode)
    staged = rows.join(progress, key, "left").withColumn("_s", F.when(F.col("questions").isNotNull(), F.when(F.col("mode") == "sheet", sheet_stage()).otherwise(paper_stage())))
    return staged.select(*papers.columns, "mode", F.col("_s.stage").alias("stage"), F.col("_s.done").alias("done"), F.col("_s.total").alias("total"), (F.col("_s.stage") == "done").alias("finished"))


#: cells of a mode's progress bar, with those that need an artifact; and the cell of each stage
CELLS = {"paper": [("ingest", False), ("segment", False), ("solve", False), ("spec", False), ("scene", True), ("assemble", True)], "sheet": [("refread", False), ("kpmark", False)]}
CELL_OF = {
    "paper": {"ingest": "ingest", "segment": "segment", "solve": "solve", "outline": "solve", "kpmark": "solve", "pick": "spec", "spec": "spec", "check": "spec", "scene": "scene", "assemble": "assemble"},
    "sheet": {"refread": "refread", "stemread": "kpmark", "kpmark": "kpmark"},
}


def cell_bar(mode: str, stage: Column, done: Column, failed: Column, artifacts: Column) -> Column:
    """array<struct<position, cell, state>>: each cell of a mode, in order: ``fail``, ``now``, ``done``, ``todo``, or ``empty`` where a cell that
    needs an artifact was passed and left none. ``artifacts`` is an array of cells."""
    cells = CELLS[mode]
    cell_of: Mapping[str, str] = CELL_OF[mode]

    def position(code: Column) -> Column:
        out = F.lit(None).cast("int")
        for s, c in cell_of.items():
            out = F.when(code == s, [x for x, _ in cells].index(c)).otherwise(out)
        return out

    at, fail = F.when(~done, position(stage)), position(failed)

    def state(i: int, cell: str, need: bool) -> Column:
        there = F.array_contains(artifacts, cell)
        first = F.when(fail.eqNullSafe(F.lit(i)), "fail").when(done, "done").when(at.isNull(), F.when(there, "done").otherwise("todo")).when(at > i, "done").when(at < i, "todo").otherwise("now")
        return F.when(first.isin("now", "fail"), first).when(there, "done").when(first == "done", "empty").otherwise(first) if need else first

    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("cell"), state(i, c, need).alias("state")) for i, (c, need) in enumerate(cells)])


def cell_states(items: DataFrame, mode: str, stage: Column, done: Column, failed: Column, artifacts: Column) -> DataFrame:
    """each item with each cell of a mode, as :func:`cell_bar` tells them."""
    bar = items.withColumn("_c", F.explode(cell_bar(mode, stage, done, failed, artifacts)))
    return bar.select(*items.columns, *[F.col(f"_c.{c}").alias(c) for c in ("position", "cell", "state")])


def sheet_state(status: Column, note: Column, seconds: Column, answers: Column) -> Column:
    """F8: struct<state, note, run_seconds>: running, failed, done, or empty without an answer; seconds of running ones alone."""
    state = F.when(status == "running", "running").when(status == "error", "failed").when(answers > 0, "done").otherwise("empty")
    return F.struct(state.alias("state"), note.alias("note"), F.when(status == "running", F.coalesce(seconds.cast("long"), F.lit(0))).alias("run_seconds"))


def sheet_report(pages: Column, calls: Column, aborted: Column, clashes: Column, ok: Column, why: Column, most: int = 6) -> Column:
    """the lines that tell how reading a sheet went: calls, those that failed, why it was given up, the first conflicts and
    how many more, and the check of the total. ``calls`` is array<struct<page, pass, ok>>, ``clashes`` array<string>."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    bad = F.filter(calls, lambda c: ~c["ok"])
    return F.array_compact(F.concat(
        F.array(text("reading: ", pages, " pages, ", F.size(calls), " calls"), F.when(F.size(bad) > 0, text("  ! ", F.size(bad), " calls failed: ", F.array_join(F.transform(bad, lambda c: text("page ", c["page"], " ", c["pass"])), ", "))), F.when(F.coalesce(aborted, F.lit("")) != "", text("  x ", aborted))),
        F.transform(F.slice(clashes, 1, most), lambda c: text("  ! ", c)),
        F.array(F.when(F.size(clashes) > most, text("  ! ", F.size(clashes) - most, " more conflicts")), F.when(ok, text("  ok ", why)).otherwise(text("  ! ", why))),
    ))


def plan_reason(only: Column, done: Column, has_spec: Column, animatable: Column, status: Column, worth: Column, allow_draft: bool = False, do_all: bool = False, redo: bool = False) -> Column:
    """The first reason not to make a question's scene, null for those to be made.

    ``only`` is null, or whether the question is among those asked for by number, which are made again and without a verdict
    on their worth. Tests go from the cheapest to the dearest.
    """
    named = F.coalesce(only, F.lit(False))
    return (
        F.when(~F.coalesce(only, F.lit(True)), "not asked for")
        .when(done & ~named & F.lit(not redo), "done")
        .when(~has_spec, "no spec")
        .when(~animatable, "not animatable")
        .when((~status.eqNullSafe(F.lit("approved"))) & F.lit(not allow_draft), "not approved")
        .when((~worth) & F.lit(not do_all), "not worth it")
        .when(worth.isNull() & ~named & F.lit(not do_all), "unjudged")
    )
