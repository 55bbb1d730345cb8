"""Every registered query against DuckDB on the smallest tables, plus plan checks."""

import re

import pytest

from workload import QUERIES
from workload.compare import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    assert check(spark, duck, FOLDER, name).startswith(("ok", "rows"))


PLAN_SAMPLE = [n for n in QUERIES if n.startswith("gap_") or n in ("abc_xyz_matrix", "sales_report", "box_stats", "overstock_rate")]


@pytest.mark.parametrize("name", PLAN_SAMPLE)
def test_no_cross_join(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["weekly_performance"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "l_extendedprice" in read
    assert "l_tax" not in read and "l_returnflag" not in read and "l_orderkey" not in read


def test_filter_reaches_scan(spark):
    plan = QUERIES["parquet_scan"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
