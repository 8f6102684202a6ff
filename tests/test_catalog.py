"""Every registered query against its check SQL, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from searchlab.plans.catalog import QUERIES
from tests.compare import check, connect

SF = os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check_sql(spark, connection, name):
    problem, rows, _, _ = check(spark, connection, name, SF)
    assert problem is None
    assert rows > 0


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
