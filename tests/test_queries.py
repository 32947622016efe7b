"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from lectern.queries import load_all
from oracle import compare, connect

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names():
    assert len(QUERIES) == 115
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def checked(name):
    """The query, with a look at its plan: no product of two tables."""
    def run(spark, sf):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        return df

    return run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, con, name):
    _, problems = compare(spark, con, sf, checked(name), ORACLES[name])
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert checked(name)(spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pushdown(spark, sf):
    plan = QUERIES["scan_changed_since"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    pruned = QUERIES["set_difference"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in pruned
