"""Queries that have SQL, against DuckDB."""

import duckdb
import pytest

from keyfold.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    names = sorted(found.columns)
    assert sorted(want.columns) == names
    rows = lambda d: sorted(repr([str(x) for x in r]) for r in d[names].itertuples(index=False))
    assert rows(found) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
