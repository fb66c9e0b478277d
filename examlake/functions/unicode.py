"""Unicode normal forms, by the tables of Python's ``unicodedata``, over Arrow batches. Null stays null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFKC")


def _normal(text: str | None, form: str) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize(form, text)


@lru_cache
def _of_texts(form: str) -> Callable:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_normal(t, form) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")


@lru_cache
def _of_arrays(form: str) -> Callable:
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [_normal(t, form) for t in a] for a in arrays], dtype=object)

    return F.pandas_udf(run, "array<string>")


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """A text in the form NFC or NFKC; not within a lambda, where :func:`normal_forms` of the array is to be used."""
    if form not in FORMS:
        raise ValueError(form)
    return _of_texts(form)(text)


def normal_forms(texts: Column, form: str = "NFKC") -> Column:
    """Each text of an array in the form NFC or NFKC."""
    if form not in FORMS:
        raise ValueError(form)
    return _of_arrays(form)(texts)
