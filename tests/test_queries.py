"""Every registered query against its SQL."""

import __spark_entry__ as entry_module
import pytest
from compare import differences, duckdb_on

QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_on(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 1
