"""Every registered query against its SQL, over the whole tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck):
    assert difference(RUN[name](spark, SF_DIR), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_runs(name, spark):
    assert RUN[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10
