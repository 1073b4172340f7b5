"""Each registered query against its SQL counterpart on the star tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import compare

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf_dir, connection, name):
    result = entry.queries()[name](spark, sf_dir)
    columns, found = compare.spark_rows(result)
    sql_columns, expected = compare.sql_rows(connection, SQL[name])
    assert columns == sql_columns
    assert len(found) == len(expected)
    assert found == expected


def test_every_query_has_sql():
    """Corpus queries that SQL can't express have brute-force tests of their own."""
    library = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert library <= set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
