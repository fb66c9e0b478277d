"""Assertions as a table, each on the samples of the case that it names; thousands of specifications run in one job.

``assertions`` has (spec, case, id, expression, report, constants): ``report`` is an expression whose value is given where the assertion does not hold, ``constants`` a
map<string,double>; both may be null. ``samples`` has (spec, case, name, at, value), in any order. What expressions may hold is checked by :mod:`series`.

Defined cases: a null value is not a number; a case that has no samples, or is null, is ``missing``; an expression that is null or cannot be read or evaluated is an ``error`` and
stops no other; of samples with the same place the order is that of their values; tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .series import FUNCTIONS, _compiled

_FAULTS = (ArithmeticError, IndexError, TypeError, ValueError, AttributeError, RecursionError, MemoryError)


def _value(expression: str, data: dict) -> object:
    code, names = _compiled(expression)
    if code is None:
        raise ValueError(expression)
    unknown = [n for n in names if n not in data]
    if unknown:
        raise NameError(unknown[0])
    with np.errstate(all="ignore"):
        return eval(code, {"__builtins__": {}}, data)  # noqa: S307


def _outcome(expression: str | None, data: dict) -> tuple[str, str | None]:
    try:
        return str(bool(np.all(_value(expression or "", data)))).lower(), None
    except NameError as unknown:
        return "unknown name", str(unknown)
    except _FAULTS:
        return "error", None


def _answers(asked: list[dict], series: list[tuple[str, list]] | None) -> Iterator[tuple]:
    """(id, outcome, name, found) of the assertions of one case; ``series`` has its names with their values in order."""
    known = {str(n): np.array([np.nan if v is None else v for v in values], float) for n, values in series or []}
    for r in asked:
        outcome, name, found = "missing", None, None
        if known:
            data = {**FUNCTIONS, **dict(r["constants"] or []), **known}
            outcome, name = _outcome(r["expression"], data)
            if outcome == "false" and r["report"]:
                try:
                    found = np.atleast_1d(np.asarray(_value(r["report"], data), dtype=float)).ravel().tolist()
                except (NameError, *_FAULTS):
                    found = []
        yield r["id"], outcome, name, found


def check(assertions: DataFrame, samples: DataFrame) -> DataFrame:
    """(spec, case, id, outcome, name, found): ``true``, ``false``, ``unknown name`` (which), ``error`` or ``missing`` for each
    assertion; ``found`` is what its report came to, to four places, and empty if that could not be told.

    A case's samples are put into one row, in order, and meet its assertions there: one curve of some hundred points.
    """
    # new names, as both sides may come from one table
    key = [F.col("spec").alias("spec"), F.col("case").alias("case")]
    asked = assertions.select(*key, F.struct("id", "expression", "report", "constants").alias("a")).groupBy("spec", "case").agg(F.collect_list("a").alias("asked"))
    some = samples.select(*key, "name", F.struct(F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value")).alias("s")).where("name IS NOT NULL AND case IS NOT NULL")
    curves = some.groupBy("spec", "case", "name").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["value"]).alias("values"))
    series = curves.groupBy("spec", "case").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("series"))
    both = asked.join(series, ["spec", "case"], "left")
    kinds = {f.name: f.dataType for f in assertions.schema.fields}
    schema = StructType([*[StructField(c, kinds[c]) for c in ("spec", "case", "id")], *StructType.fromDDL("outcome string, name string, found array<double>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(spec, case, *told) for spec, case, wanted, known in zip(*(b.column(c).to_pylist() for c in ("spec", "case", "asked", "series")), strict=True) for told in _answers(wanted, known)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], names=arrow.names)

    return both.mapInArrow(run, schema).withColumn("found", F.transform("found", lambda x: F.round(x, 4)))


def gate(assertions: DataFrame, samples: DataFrame) -> DataFrame:
    """(spec, case, id, outcome, found): ``true``, ``false``, ``error`` or ``missing``; a specification without any sample has one
    row, ``no series``, in place of its assertions."""
    there = samples.where("name IS NOT NULL AND case IS NOT NULL").select("spec").distinct()
    none = assertions.select("spec").distinct().join(there, "spec", "left_anti")
    checked = check(assertions.join(there, "spec", "left_semi"), samples).withColumn("outcome", F.when(F.col("outcome") == "unknown name", "error").otherwise(F.col("outcome"))).drop("name")
    kind = {f.name: f.dataType for f in checked.schema.fields}
    skipped = none.select("spec", *[(F.lit("no series") if c == "outcome" else F.lit(None)).cast(kind[c]).alias(c) for c in checked.columns if c != "spec"])
    return checked.unionByName(skipped)


def verdicts(outcomes: DataFrame) -> DataFrame:
    """(spec, n_held, n, passed) from outcomes of either; a specification without assertions is not among them."""
    own = outcomes.groupBy("spec").agg(F.count_if(F.col("outcome") == "true").alias("n_held"), F.count("*").alias("n"))
    return own.withColumn("passed", F.col("n_held") == F.col("n"))
