"""Every registered operator against DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from stridelake.plans import fixtures, registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, sf, name):
    got = registry.queries()[name](spark, sf)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)
