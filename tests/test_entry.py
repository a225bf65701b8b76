"""All registered queries against SQL on another engine."""

import pytest
from comparing import database, difference

import __spark_entry__ as entry_points
from stackroom.plans.oracle import ORACLE_SQL
from stackroom.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLE_SQL.keys() <= entry_points.oracle_sql().keys()


# Plan nodes that would not hold up on large tables.
UNWANTED = ["Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "Window", "collect_"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # the scan of an object store is a data source in Python
    plan = "\n".join(line for line in plan.splitlines() if "BatchScan object_store" not in line)
    assert [node for node in UNWANTED if node in plan] == []
    assert difference(frame, connection, entry_points.oracle_sql()[name]) is None


def test_flagship(spark):
    page = entry_points.entry(spark).collect()
    assert 0 < len(page) <= 20
    assert all("the" in row.title.lower() for row in page)
    assert [(r.created_at, r.id) for r in page] == sorted(((r.created_at, r.id) for r in page), reverse=True)


def test_listings_are_ordered(spark):
    listed = entry_points.queries()["catalog_recent"](spark, FOLDER).collect()
    order = [(row.created_at, row.id) for row in listed]
    assert order == sorted(order, reverse=True)
