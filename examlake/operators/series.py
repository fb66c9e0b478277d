"""Assertions over sampled series.

An assertion is a short expression over the columns of one case's samples, as in ``all(diff(u) > 0)``. It is checked
against a list of allowed forms and evaluated with numpy in the task that has the case's samples; nothing else of the
language can be reached. A failure, an error and a missing case are three different results.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from functools import lru_cache
from types import CodeType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the functions and the constant that assertions may use
FUNCTIONS = {
    "abs": np.abs, "min": np.min, "max": np.max, "argmin": np.argmin, "argmax": np.argmax, "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos, "tan": np.tan, "arctan": np.arctan, "exp": np.exp, "log": np.log, "pi": np.pi, "diff": np.diff,
    "where": np.where, "all": np.all, "any": np.any, "sum": np.sum, "mean": np.mean, "std": np.std, "isfinite": np.isfinite, "sign": np.sign, "interp": np.interp, "len": len, "clip": np.clip, "sort": np.sort, "cumsum": np.cumsum, "nonzero": np.nonzero,
}
_NODES = (ast.Expression, ast.Call, ast.Name, ast.Load, ast.Constant, ast.BinOp, ast.UnaryOp, ast.Compare, ast.BoolOp, ast.Subscript, ast.Slice, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)


def checked(expression: str) -> ast.Expression:
    """The expression's tree, if it uses allowed forms alone; numbers are its only constants."""
    tree = ast.parse(expression, mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, _NODES):
            raise ValueError(f"{type(node).__name__} is not allowed")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and callable(FUNCTIONS.get(node.func.id)) and not node.keywords):
            raise ValueError("only known functions can be called")
        if isinstance(node, ast.Constant) and not isinstance(node.value, int | float):
            raise ValueError("only numbers can be constants")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow) and not isinstance(node.right, ast.Constant):
            raise ValueError("only constant powers")
    return tree


def names_in(expression: str) -> list[str]:
    """The series that an expression uses."""
    return sorted({n.id for n in ast.walk(checked(expression)) if isinstance(n, ast.Name) and n.id not in FUNCTIONS})


@lru_cache(maxsize=4096)
def _compiled(expression: str) -> tuple[CodeType | None, tuple[str, ...]]:
    """The code and the names of an expression, worked out once in a worker; no code if it is not allowed."""
    try:
        return compile(checked(expression), "assertion", "eval"), tuple(names_in(expression))
    except (SyntaxError, ValueError):
        return None, ()


def check(samples: DataFrame, case: str, order: str, keys: Sequence[str], assertions: Sequence[tuple[str, ...]], constants: Mapping[str, float] | None = None) -> DataFrame:
    """(case, id, outcome, report) with outcome true, false, ``unknown name`` or ``error``, every assertion on every case; those that
    name their case are checked by :mod:`assertions` (E1, E2).

    An assertion is (id, expression) or (id, expression, report), the latter an expression whose value, to four places, is
    given where the assertion does not hold. ``constants`` are names with values. Nulls are not a number. An expression
    that cannot be read is an error of its own and stops no other. A case's samples meet in one task; a case is one curve
    of some hundred points.
    """
    fixed = {**FUNCTIONS, **(constants or {})}

    def value(expression: str, data: dict) -> object:
        code, names = _compiled(expression)
        if code is None:
            raise ValueError(expression)
        if any(n not in data for n in names):
            raise NameError(expression)
        with np.errstate(all="ignore"):
            return eval(code, {"__builtins__": {}}, data)  # noqa: S307

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        data = {**fixed, **{k: pdf[k].to_numpy(dtype=float, na_value=np.nan) for k in keys}}
        out = []
        for i, expression, *report in assertions:
            said = None
            try:
                outcome = str(bool(np.all(value(expression, data)))).lower()
            except NameError:
                outcome = "unknown name"
            except (ArithmeticError, IndexError, TypeError, ValueError):
                outcome = "error"
            if outcome == "false" and report:
                try:
                    said = np.atleast_1d(np.asarray(value(report[0], data), dtype=float)).ravel().tolist()
                except (ArithmeticError, IndexError, NameError, TypeError, ValueError):
                    said = []
            out.append((pdf[case].iloc[0], i, outcome, said))
        return pd.DataFrame(out, columns=[case, "id", "outcome", "report"])

    kind = dict(samples.dtypes)[case]
    found = samples.select(case, order, *keys).groupBy(case).applyInPandas(run, f"{case} {kind}, id string, outcome string, report array<double>")
    text = F.array_join(F.transform("report", lambda x: F.round(x, 4).cast("string")), " ")
    return found.withColumn("report", F.when(F.size("report") == 0, "error").otherwise(text))


def finiteness(samples: DataFrame, case: str, value: str) -> DataFrame:
    """Samples and those that are null or not finite."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return samples.groupBy(case).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


def interpolate(samples: DataFrame, case: str, u: str, value: str, at: Column) -> DataFrame:
    """The value at ``at`` on the straight line between the samples around it."""
    line = Window.partitionBy(case).orderBy(u)
    steps = samples.withColumn("_u", F.lead(u).over(line)).withColumn("_v", F.lead(value).over(line)).withColumn("_at", at)
    inside = steps.where((F.col(u) <= F.col("_at")) & (F.col("_at") < F.col("_u")))
    return inside.select(case, (F.col(value) + (F.col("_v") - F.col(value)) * (F.col("_at") - F.col(u)) / (F.col("_u") - F.col(u))).alias("value"))
