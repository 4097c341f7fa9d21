"""Plan guards for the scale rules: no cross / nested-loop joins and no Python UDFs in any
plan of the library's queries, and filters reach the parquet scan."""

import pytest

from tambo.registry import queries

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_of(spark, name):
    return queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_forbidden_operators(spark, name):
    plan = plan_of(spark, name)
    assert not [op for op in FORBIDDEN if op in plan]


@pytest.mark.parametrize("name", ["filter_dashboard", "filter_units", "kpis_filtered"])
def test_dates_reach_the_scan(spark, name):
    pushed = [line for line in plan_of(spark, name).splitlines() if "l_shipdate" in line and "PushedFilters" in line]
    assert any("ThanOrEqual(l_shipdate" in line or "Than(l_shipdate" in line for line in pushed)


@pytest.mark.parametrize("name", ["increments_raw_rows", "scale_pair_sales"])
def test_positions_need_no_global_sort(spark, name):
    assert "rangepartitioning" not in plan_of(spark, name)
