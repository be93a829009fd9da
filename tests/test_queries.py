"""Every registered catalog query against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import connection, same
from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    same(spark, con, FOLDER, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_media_audit_gathers_no_rows(spark):
    """Lists of a product's media are counted and repeated: no aggregate that keeps rows of a group on the heap."""
    plan = QUERIES["media_audit"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
