"""Folds over a key's ordered rows that stream: a task holds one batch and the state, never a key's rows.

A key's rows meet in one task, sorted on disk if need be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD = 8192


def streamed(rows: DataFrame, by: str, order: Sequence[str], values: Sequence[str], each: Callable[[Iterator[tuple]], Iterable[tuple]], made: str) -> DataFrame:
    """The ``values`` of each key's rows, in order, through ``each(rows)``, whose tuples are the columns ``made`` after the key."""
    schema = StructType([rows.schema[by], *StructType.fromDDL(made)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], names=arrow.names)

        flow = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for key, own in groupby(flow, key=lambda r: r[0]):
            for row in each(r[1:] for r in own):
                out.append((key, *row))
                if len(out) >= HELD:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    # dealt by a hash of its own: a shuffle by the key alone is dropped where a join below has the same, and that join may still become one that has none
    return rows.repartition(F.xxhash64(by)).sortWithinPartitions(by, *order).select(by, *values).mapInArrow(run, schema)


def with_upper_median(rows: DataFrame, by: str | Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the value in the one row that is its key's upper middle, null in the others."""
    line = Window.partitionBy(*[by] if isinstance(by, str) else by)
    k, n = F.row_number().over(line.orderBy(value.asc_nulls_last())), F.count(value).over(line)
    return rows.withColumn(name, F.when(k == F.floor(n / 2) + 1, value))
