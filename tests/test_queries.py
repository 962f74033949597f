"""Every registered query at the smallest scale, next to its SQL twin."""

import os

import pytest

import __spark_entry__ as entry
from catalog.compare import check, sql_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return sql_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    result, _, rows = check(spark, connection, FOLDER, QUERIES[name], SQL.get(name))
    assert result in ("ok", "no sql"), result
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
