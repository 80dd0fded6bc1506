"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry_points
from check import compare, oracle_connection
from docloom.queries.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    verdict, rows, _ = compare(spark, con, sf, name)
    assert verdict in ("ok", "rows only"), verdict


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["qid", "payload"]
    assert df.count() > 0
