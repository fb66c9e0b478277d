"""Audits, digests, attempts and access state: what is wrong with which rows, and what may be done now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(key, kind, message) for every rule that a row breaks; all rules are tested in one pass."""
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message"))) for kind, message, c in rules]))
    return rows.select(key, F.explode(broken).alias("f")).select(key, "f.kind", "f.message")


def audit(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Findings and flagged rows by kind, with their share of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    per = found.groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_distinct(key).alias("n_flagged"))
    return per.join(total, how="cross").select("kind", "n_findings", "n_flagged", F.round(F.col("n_flagged") * 100.0 / F.col("total"), 4).alias("percent"))


def changed_characters(texts: DataFrame, before: Column, after: Column) -> DataFrame:
    """Each character that a translation changes, what to, and how often it stands."""
    chars = texts.select(F.explode(F.arrays_zip(F.split(before, "").alias("a"), F.split(after, "").alias("b"))).alias("c"))
    return chars.select(F.col("c.a").alias("before"), F.col("c.b").alias("after")).where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


def attempts(log: DataFrame, key: str, order: str, ok: Column, retryable: Column, most: int = 3) -> DataFrame:
    """ST10: how many attempts count: to the first that succeeds or may not be repeated, ``most`` at the outside."""
    line = Window.partitionBy(key).orderBy(order)
    marked = log.withColumn("_k", F.row_number().over(line)).withColumn("_ok", ok).withColumn("_end", F.col("_ok") | ~retryable)
    before = F.coalesce(F.max(F.col("_end").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = marked.withColumn("_before", before).where((F.col("_before") == 0) & (F.col("_k") <= most))
    return kept.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_or("_ok").alias("succeeded"))


def keep_better(ledger: DataFrame, keys: Sequence[str], rows: str, order: str) -> DataFrame:
    """ST11: of repeated calls the one with the most rows, the first at a tie."""
    best = F.max(F.struct(F.col(rows), (-F.col(order)).alias("_o")))
    return ledger.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("calls")).select(*keys, F.col(f"b.{rows}").alias(rows), (-F.col("b._o")).alias(order), "calls")


def login_codes(tries: DataFrame, key: str, order: str, seconds: Column, right: Column, expires: int, most: int = 5) -> DataFrame:
    """ST3: a key's code is accepted once, before it expires and within so many tries: (key, accepted id, tries)."""
    # a try beyond the first ``most`` is never open
    nth = F.row_number().over(Window.partitionBy(key).orderBy(seconds, F.col(order).cast("long"), right))
    events = tries.withColumn("_nth", nth).where(F.col("_nth") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("t"), F.col(order).cast("long").alias("id"), right.alias("ok")))).alias("events"))
    start = F.element_at("events", 1)["t"]

    def step(acc: Column, x: Column) -> Column:
        open_ = acc["id"].isNull() & (acc["tries"] < most) & (x["t"] - acc["start"] < expires)
        return F.struct(acc["start"].alias("start"), (acc["tries"] + open_.cast("int")).alias("tries"), F.when(open_ & x["ok"], x["id"]).otherwise(acc["id"]).alias("id"))

    zero = F.struct(start.alias("start"), F.lit(0).alias("tries"), F.lit(None).cast("long").alias("id"))
    return events.select(key, F.aggregate("events", zero, step).alias("a")).select(key, F.col("a.id").alias("accepted"), F.col("a.tries").alias("tries"))


def numbering_problems(rows: DataFrame, by: str, n: str) -> DataFrame:
    """Main numbers that stand both whole and with parts (n >= 100: parts of n div 100)."""
    main = F.when(F.col(n) >= 100, F.floor(F.col(n) / 100)).otherwise(F.col(n))
    per = rows.groupBy(by, main.alias("main")).agg(F.bool_or(F.col(n) < 100).alias("whole"), F.count_if(F.col(n) >= 100).alias("n_parts"))
    return per.where("whole AND n_parts > 0").select(by, "main", "n_parts")


def provides_all(cases: DataFrame, case: str, key: str, wanted: Sequence[str]) -> DataFrame:
    """Which wanted keys a case lacks; none means that it will do."""
    per = cases.groupBy(case).agg(F.collect_set(key).alias("have"))
    lacking = F.array_except(F.array(*map(F.lit, sorted(wanted))), F.col("have"))
    return per.select(case, F.array_join(lacking, ",").alias("lacking"), (F.size(lacking) == 0).alias("usable"))


def needs_advice(answers: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Answers that lost points, wrong or in part, to questions that have a reference."""
    lost = answers.where(F.col("verdict").isin("wrong", "partial") & (F.col("score_got") < F.col("score_full")))
    return lost.join(references.select(key).distinct(), key, "left_semi")


def coverage(frames: DataFrame, key: str, inside: Column, snapshot: str) -> DataFrame:
    """Whether each element is inside in some frame, and changes at all."""
    return frames.groupBy(key).agg(F.bool_or(inside).alias("drawn"), (F.count_distinct(snapshot) > 1).alias("changes"))


def invalid(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Rows whose value is not of the domain, null included."""
    return rows.where(~F.coalesce(F.col(column).isin(list(domain)), F.lit(False)))


def last_substantial(rows: DataFrame, key: str, order: str, text: str, hollow: Column) -> DataFrame:
    """Per key the last row counts; if what it says is hollow, the key has nothing."""
    last = rows.withColumn("_h", hollow).groupBy(key).agg(F.max(F.struct(order, "_h", text)).alias("m"))
    return last.where("NOT m._h").select(key, F.col(f"m.{text}").alias(text))


def approve(specs: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """A specification is approved if all its assertions hold, rejected if any does not, left alone without any."""
    per = outcomes.groupBy(key).agg(F.bool_and(F.col("outcome") == "true").alias("_all"))
    return specs.join(per, key, "left").withColumn("status", F.when(F.col("_all"), "approved").when(~F.col("_all"), "rejected").otherwise(F.col("status"))).drop("_all")
