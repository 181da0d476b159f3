import os

import duckdb
import pytest

import __spark_entry__ as entry
from colligate import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def sorted_rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, db, name):
    assert sorted_rows(queries.QUERIES[name](spark, SF).toPandas()) == sorted_rows(db.sql(queries.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
