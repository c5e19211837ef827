"""Every registered query that has SQL equals it on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import connect, differences

from quern.plans.oracle import SQL
from quern.plans.queries import QUERIES

SF = os.environ.get("QUERN_TEST_DATA", "/root/testdata") + "/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    assert differences(spark, db, QUERIES[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
