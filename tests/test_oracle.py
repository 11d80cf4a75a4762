"""Every registered query against its DuckDB twin.

SHELFWISE_SF_DIR chooses the data folder; the smallest one is the default.
"""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import differences, duck

SF = os.environ.get("SHELFWISE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_module.all_queries()
ORACLE = entry_module.oracle_queries()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, SF), connection, ORACLE[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
