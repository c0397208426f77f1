"""Every query with SQL against DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from keyfold.plans.queries import ORACLES, QUERIES

SF = os.environ.get("KEYFOLD_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(df):
    names = sorted(df.columns)
    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else (float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return names, sorted(repr([cell(x) for x in row]) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert shown(found) == shown(duck.sql(ORACLES[name]).df())
    else:
        assert len(found) and found["event_id"].is_unique
