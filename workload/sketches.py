"""Roll-ups of stored sketch states, checked against exact counts."""

from pyspark.sql import functions as F

from aislemetrics.functions import sketches
from aislemetrics.session import scratch_path
from workload.registry import query

def levels():
    return {"all": F.lit("all"), "store": F.col("store_nbr"), "year": F.floor(F.col("wm_yr_wk_nbr") / 100)}


def stored(v):
    """States per (week, store) of items sold and sales amounts, written once."""
    path = scratch_path(v.spark, "states")
    fine = sketches.states(v.weekly_sales, ["wm_yr_wk_nbr", "store_nbr"], {"item_nbr": "item_nbr"}, {"wkly_sales_amt": "wkly_sales_amt"})
    fine.write.parquet(path)
    return v.spark.read.schema(fine.schema).parquet(path)


TALL = (
    "select item_nbr, wkly_sales_amt, unnest(['all', 'store', 'year']) as level, "
    "unnest(['all', store_nbr::varchar, (wm_yr_wk_nbr // 100)::varchar]) as dimension from weekly_sales"
)

query(
    "sketch_distinct_items",
    "D4",
    f"select level, dimension, count(*) as rows, count(distinct item_nbr) as exact, true as within from ({TALL}) group by 1, 2",
)(
    lambda v: sketches.checked(v.weekly_sales, stored(v), levels(), "item_nbr", "wkly_sales_amt").select(
        "level", "dimension", "rows", "exact", "within"
    )
)
query(
    "sketch_median_sales",
    "D15",
    f"select level, dimension, count(*) as rows, true as middle_within from ({TALL}) group by 1, 2",
)(
    lambda v: sketches.checked(v.weekly_sales, stored(v), levels(), "item_nbr", "wkly_sales_amt").select(
        "level", "dimension", "rows", "middle_within"
    )
)
