"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    return repr(round(x, 6)) if isinstance(x, float) else repr(x)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["edge_id", "reason", "period"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
