"""Bucketed tables and SQL functions."""

from pyspark.sql import functions as F

from aislemetrics.functions.columns import bins
from aislemetrics.operators import prepare, sql_functions
from aislemetrics.sources.files import bucket_count
from aislemetrics.sources.retail_views import RetailViews
from workload import tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_and_joins_run_on_the_buckets(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(tables.folded(RetailViews(spark, FOLDER)))
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucket_count_follows_the_size():
    assert bucket_count(1000, 40) == 1
    assert bucket_count(10**12, 100) == 1 << 19  # 100 TB in files of 256 MB at most
    assert 10**12 * 100 / bucket_count(10**12, 100) <= 256 << 20


def test_sql_functions_are_inlined(spark):
    sql_functions.register(spark)
    plan = plan_of(tables.classified(RetailViews(spark, FOLDER)))
    assert "Python" not in plan and "CASE WHEN" in plan
    rows = [(x,) for x in (None, -1.0, 0.0, 0.5, 1.0, 5.0, 5.01, 10.0, 15.0, 50.0, 50.5, 100.0, 500.0, 501.0)]
    got = spark.createDataFrame(rows, "x double").selectExpr("x", "price_segment(x) as p", "sales_class(x) as s", "stock_class(x) as q")
    levels = {"op": prepare.PRICE_SEGMENTS, "os": prepare.SALES_LEVELS, "oq": prepare.STOCK_LEVELS}
    own = got.withColumns({n: bins(F.col("x"), *at) for n, at in levels.items()})
    for r in own.collect():
        assert (r.p, r.s, r.q) == (r.op, r.os, r.oq), r
