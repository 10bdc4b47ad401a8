"""Queries of case_queries, citation_queries, plan_queries, source_queries and table_queries against their SQL, over the smallest tables."""

import duckdb
import pytest

from quire import case_queries, citation_queries, plan_queries, source_queries, table_queries
from quire.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ in (case_queries.__name__, citation_queries.__name__, plan_queries.__name__, source_queries.__name__, table_queries.__name__))


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "conversations", "documents"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    found = tables.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((repr(r) for r in found.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
