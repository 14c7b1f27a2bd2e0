"""Every named query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from trialmart.plans import catalog
from verification import oracle
from verification.compare import connect, difference

SF_DIR = entry_points.SMOKE_DIR
# The corpus operators have tests of their own.
QUERIES = catalog.queries()
SQL = oracle.sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert [r["is_target"] for r in rows] == [0, 1]
