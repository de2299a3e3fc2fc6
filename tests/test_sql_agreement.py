"""Every registered query agrees with its SQL on the smallest tables."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from tablescope.catalog.oracles import ORACLES
from tablescope.catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"both empty"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    found = differences(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert [f for f in found if f not in MAY_BE_EMPTY] == []


def test_queries_and_sql_go_together():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == [
        "category", "metric", "top_contributor", "contribution_pct", "is_concentrated",
    ]
