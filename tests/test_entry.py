"""The queries against their SQL, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

DATA = Path("/root/testdata/sf0.001")
HEAVY = {"pagerank"}


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(e.oracle_sql()) - HEAVY))
def test_query_equals_sql(spark, con, name):
    got = e.queries()[name](spark, str(DATA))
    want = con.sql(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry_runs(spark):
    assert e.entry(spark).count() > 0
