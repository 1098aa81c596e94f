"""Every query with SQL against that SQL, on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest
from citegrid.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "orders lineitem part documents pages".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == cols
    assert got == sorted(repr(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
