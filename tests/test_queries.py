"""Every query of the library against its SQL, and without it that it runs, over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyvine import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and np.isnan(value):
        return None
    number = isinstance(value, (int, float, np.integer, np.floating)) and not isinstance(value, (bool, np.bool_))
    return round(float(value), 6) if number else bool(value) if isinstance(value, np.bool_) else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        expected = duck.sql(queries.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
