import duckdb
import pytest

from colligate.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    one, two = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(one.columns) == sorted(two.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(one) == rows(two)
