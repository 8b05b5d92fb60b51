"""Every registered query agrees with its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Corpus operators have tests of their own.
QUERIES, ORACLES = entry.load_all().QUERIES, entry.load_all().ORACLES


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, count = check.compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem
    assert count > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
