"""Every registered query of the library's own operators against its checking SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from parcelweave.plans import catalog, landed_queries  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_registered_query(spark, engine, name):
    ok, message = compare(spark, engine, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
