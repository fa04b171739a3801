"""Every registered query against its SQL in DuckDB, on the smallest test data."""

import pytest

import __spark_entry__ as registered
from checks.compare import connect, difference

# The corpus queries have tests of their own, beside their package.
CORPUS = set(registered.corpus.QUERIES) if registered.corpus else set()
QUERIES = {name: query for name, query in registered.queries().items() if name not in CORPUS}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name not in CORPUS}


@pytest.fixture(scope="module")
def duck(small_folder):
    return connect(small_folder)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, small_folder, name):
    actual = QUERIES[name](spark, small_folder).toPandas()
    assert difference(actual, duck.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0
