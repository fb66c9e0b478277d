"""Registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, checking, cutting, extras, geometry, grading, ordered, pages, papers, records, rollups, satellites, sheetwork, texts, upkeep

_ALL = {**rollups.QUERIES, **ordered.QUERIES, **texts.QUERIES, **pages.QUERIES, **audits.QUERIES, **records.QUERIES, **grading.QUERIES, **sheetwork.QUERIES, **cutting.QUERIES, **checking.QUERIES, **extras.QUERIES, **satellites.QUERIES, **geometry.QUERIES, **upkeep.QUERIES, **papers.QUERIES}
FLAGSHIP = "a2_list_sheets"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
