"""Every query with an SQL twin against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", OWN)
def test_twin(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(df.columns)) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
