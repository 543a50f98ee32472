"""Every query against its oracle statement at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import suite
from tests.compare import differences, oracle

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, STATEMENTS[name]) is None


def test_every_query_of_the_suite_has_a_statement():
    """Queries on training data without one are held against brute force in their own tests."""
    assert set(suite.QUERIES) <= set(STATEMENTS) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
