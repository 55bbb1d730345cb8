"""Queries over bucketed tables and in SQL text."""

import uuid

from pyspark.sql import functions as F

from aislemetrics.operators import sql_functions
from aislemetrics.session import scratch_path
from aislemetrics.sources.files import bucket_count, save_bucketed
from workload.registry import query

PAIR = ["store_nbr", "item_nbr"]
BUCKET_BYTES = 32 << 20


def bucketed(v):
    """Weekly sales and store prices, clustered by store and item in the same buckets."""
    mark = uuid.uuid4().hex
    # a bucket is folded in one task, whose memory is some fifteen times the bucket's rows as counted here
    buckets = max(4, bucket_count(v.table("lineitem").count(), 40, BUCKET_BYTES))
    tables = []
    for name, df in (("sales", v.weekly_sales), ("prices", v.store_price)):
        columns = [*PAIR, "wkly_sales_amt", "wkly_qty"] if name == "sales" else [*PAIR, "live_price_amt"]
        tables.append(save_bucketed(df.select(*columns), f"{name}_{mark}", PAIR, buckets, scratch_path(v.spark, name)))
    return tables


def folded(v):
    """Sales and price of every store and item; both folds and the join run on the buckets."""
    sales, prices = bucketed(v)
    sold = sales.groupBy(*PAIR).agg(F.sum("wkly_sales_amt").alias("sales"), F.sum("wkly_qty").alias("units"))
    priced = prices.groupBy(*PAIR).agg(F.max("live_price_amt").alias("top_price"), F.count(F.lit(1)).alias("observations"))
    return sold.join(priced.hint("merge"), PAIR)


query(
    "bucketed_store_item",
    "A3 A6 C1",
    "select store_nbr, item_nbr, sales, units, top_price, observations from "
    "(select store_nbr, item_nbr, sum(wkly_sales_amt) as sales, sum(wkly_qty) as units from weekly_sales group by 1, 2) "
    "join (select store_nbr, item_nbr, max(live_price_amt) as top_price, count(*) as observations from store_price group by 1, 2) "
    "using (store_nbr, item_nbr)",
    "sales,units:2 top_price:7",
)(folded)


def classified(v):
    sql_functions.register(v.spark)
    return v.spark.sql(
        "select price_segment(base_unit_retail_amt) as segment, sales_class(wkly_sales_amt) as sales_category, "
        "stock_class(onhand_invt_qty) as stock, count(*) as n, sum(wkly_qty) as units "
        "from {sales} join {catalog} using (item_nbr) group by 1, 2, 3",
        sales=v.weekly_sales,
        catalog=v.catalog,
    )


query(
    "sql_classifiers",
    "I1 I2 I3",
    "select price_segment as segment, sales_category, inventory_status as stock, count(*) as n, sum(wkly_qty) as units "
    "from sales_m join catalog_m using (item_nbr) group by 1, 2, 3",
    "units:2",
)(classified)
