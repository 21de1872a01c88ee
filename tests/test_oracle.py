"""Every registered query against its SQL twin on the generated tables."""

import os

import pytest

import __spark_entry__ as registered
from checks.compare import differences, duck_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TWINS = registered.oracle_sql()
QUERIES = registered.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, TWINS[name]) == []


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() == 80
