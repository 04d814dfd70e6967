"""Every registered query against its SQL on DuckDB, by column names, types and values."""

import importlib

import oracle
import pytest

from seaflow.plans import oracles, registry

SF_DIR = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
# The queries of the freight model; those of the text operators have tests of their own.
QUERIES, SQL = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, db, name):
    assert oracle.compare(spark, db, QUERIES[name], SQL[name], SF_DIR) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
