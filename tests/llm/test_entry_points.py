"""Registered queries of the operators against their SQL, on a whole small table."""

import re

import pytest
from comparing import database, difference

import __spark_entry__ as entry_points
from stackroom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(m[1]) for m in (re.fullmatch(r"op(\d+)_\w+", name) for name in QUERIES) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLE_SQL.keys() <= entry_points.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLE_SQL[name]) is None
