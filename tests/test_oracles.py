"""Every registered query with SQL is held against DuckDB on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from examlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def matches(spark, duck, run, sql):
    df = run(spark, SF)
    got = Counter(tuple(map(plain, r)) for r in df.collect())
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    matches(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_has_queries_and_stable_names():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
