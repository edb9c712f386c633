"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracemill import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, con, name):
    got = rows(own.QUERIES[name](spark, DATA).toPandas())
    if name in own.ORACLE_SQL:
        assert got == rows(con.execute(own.ORACLE_SQL[name]).df())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
