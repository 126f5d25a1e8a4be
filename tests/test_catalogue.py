"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import os

import duckdb
import pytest

from scanloom.plans.catalogue import QUERIES, SQL
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if v != v else repr(round(v, 9))
        return None if v is None else str(v)

    return sorted(tuple(str(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
