"""Every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from webweft.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{FOLDER}/{file}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda t: sorted(map(str, t[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want) and len(got)
