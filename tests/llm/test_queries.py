"""The corpus queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from tallyvine.llm import queries
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found, expected = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)
