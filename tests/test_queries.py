"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from compare import TABLES, canon
from memloom.plans import general, reference

DATA = "/root/testdata/sf0.001"
QUERIES = general.QUERIES | reference.QUERIES
ORACLES = general.ORACLES | reference.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'").fetchall()
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    r = con.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert canon(got, df.columns) == canon(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
