"""Every registered query against its SQL on the smallest data set, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from notalake.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("NOTALAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, connection, name):
    assert difference(spark, connection, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["status", "n_documents", "n_items", "calculated_cents", "stated_cents"]


def test_entry_holds_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
