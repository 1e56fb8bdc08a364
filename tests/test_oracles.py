"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LLM = {key for key in QUERIES if key == "pipeline" or key.startswith("op")}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return connection


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(ORACLES) <= LLM
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    got = [tuple(row) for row in df.collect()]
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_approximate_search_finds_most(spark, sf):
    """Recall of the three nearest, and the share of all pairs that was compared for it."""
    wanted = {(r.query_id, r.neighbour_id) for r in QUERIES["q_g3_knn"](spark, sf).collect()}
    found = {(r.query_id, r.neighbour_id) for r in QUERIES["q_g6_knn_approx"](spark, sf).collect()}
    assert len(wanted & found) >= 0.9 * len(wanted)
