"""Scans, sinks, derived columns and small building blocks."""

import uuid

from pyspark.sql import functions as F

from aislemetrics.functions import columns as cols
from aislemetrics.operators import prepare
from aislemetrics.session import scratch_path
from aislemetrics.sources import files
from workload.registry import query

WANTED = ["hg_store_id", "wm_week", "wm_city", "item_nbr", "base_unit_retail_amt", "comp_reg", "match_flag"]


def scratch(v):
    return scratch_path(v.spark, "files")


def delimited(v, sep, infer=False):
    """Write the catalog as delimited text and scan it back."""
    path = scratch(v)
    v.catalog.write.option("header", True).option("sep", sep).csv(path)
    schema = None if infer else v.catalog.schema
    return files.read_delimited(v.spark, path, schema, sep)


def summary(v):
    path = scratch(v)
    files.save_summary(v.weekly_sales.agg(F.count("*").alias("records"), F.sum("wkly_qty").alias("units")), path)
    return v.spark.read.schema("records bigint, units double").json(path)


def table_sink(v):
    """Create or replace a table, then scan it through the catalog."""
    name = f"catalog_copy_{uuid.uuid4().hex}"
    files.save_table(v.catalog, name, path=scratch(v))
    return files.read_table(v.spark, name).select("item_nbr", "brand_name", "cost")


def mean_of_price_columns(v):
    """Columns chosen by type and by name, averaged in one pass."""
    chosen = [c for c in cols.columns_named(v.store_price, "price", "amt") if c in cols.numeric_columns(v.store_price)]
    means = v.store_price.agg(*[F.avg(c).alias(c) for c in chosen])
    return means.unpivot([], chosen, "column", "mean")


query("table_sink", "A3 A6", "select item_nbr, brand_name, cost from catalog", "cost:4")(table_sink)
query(
    "price_column_means",
    "B32 B33",
    " union all ".join(
        f"select '{c}' as \"column\", avg({c}) as mean from store_price"
        for c in ("live_price_amt", "defined_reg_price_amt", "competitor_price_amt")
    ),
    "mean:7",
)(mean_of_price_columns)
query("csv_scan", "A1", "select * from catalog", "base_unit_retail_amt:2 cost:4")(lambda v: delimited(v, ","))
query("tab_scan", "A2", "select * from catalog", "base_unit_retail_amt:2 cost:4")(lambda v: delimited(v, "\t"))
query(
    "csv_inferred_scan",
    "A4",
    "select item_nbr, dept_desc, brand_type, base_unit_retail_amt, cost from catalog",
    "item_nbr:i base_unit_retail_amt:2 cost:4",
)(lambda v: delimited(v, ",", infer=True).select("item_nbr", "dept_desc", "brand_type", "base_unit_retail_amt", "cost"))
query(
    "parquet_scan",
    "A5",
    "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45",
)(
    lambda v: files.read_parquet(v.spark, f"{v.folder}/lineitem.parquet")
    .where("l_quantity > 45")
    .select("l_orderkey", "l_partkey", "l_quantity")
)
query(
    "column_subset",
    "A7",
    "select hg_store_id, wm_week, item_nbr, base_unit_retail_amt, comp_reg from instore",
    "base_unit_retail_amt,comp_reg:7",
)(lambda v: files.keep_columns(v.instore, WANTED))
query("summary_sink", "A8", "select count(*) as records, sum(wkly_qty) as units from weekly_sales", "units:2")(summary)
query("chart_rows", "A9", "select item_nbr, brand_name from catalog order by md5('42|' || item_nbr) limit 50")(
    lambda v: files.chart_rows(v.catalog, "item_nbr", 50).select("item_nbr", "brand_name")
)
query("chart_fraction", "A9", "select event_id, value from events where substr(md5('42|' || event_id), 1, 8) < '19999999'", "value:7")(
    lambda v: files.chart_fraction(v.events, "event_id", 0.1).select("event_id", "value")
)
query("preview", "A11", "select item_nbr, brand_name, cost from catalog order by item_nbr limit 5", "cost:4")(
    lambda v: files.preview(v.catalog.select("item_nbr", "brand_name", "cost"), "item_nbr", 5)
)
query(
    "coerce_numeric",
    "B1",
    "select period_description, count(*) as rows, count(try_cast(sales as double)) as numbers, sum(try_cast(sales as double)) as total from market_source group by 1",
    "total:1",
)(
    lambda v: cols.coerce_numeric(v.market_source, ["sales", "no_such_column"])
    .groupBy("period_description")
    .agg(F.count("*").alias("rows"), F.count("sales").alias("numbers"), F.sum("sales").alias("total"))
)
query("strict_cast", "B2", "select cast(upc_nbr as bigint) as upc, count(*) as n from weekly_sales group by 1")(
    lambda v: v.weekly_sales.groupBy(F.col("upc_nbr").cast("bigint").alias("upc")).agg(F.count("*").alias("n"))
)
_DATE_TEXT = "case when item_nbr % 7 = 0 then 'n/a' else cast(price_date as {}) end"
query(
    "coerce_dates",
    "B3",
    f"select cast(try_cast({_DATE_TEXT.format('varchar')} as timestamp) as date) as day, count(*) as n from store_price group by 1",
)(
    lambda v: cols.coerce_dates(v.store_price.withColumn("day", F.expr(_DATE_TEXT.format("string"))), ["day"])
    .groupBy(F.col("day").cast("date").alias("day"))
    .agg(F.count("*").alias("n"))
)
query(
    "catalog_metrics",
    "B4 B5 B8",
    "select item_nbr, margin_dollars, margin_percent, price_segment, is_active, is_national_brand, is_private_label from catalog_m",
    "margin_dollars:4 margin_percent:6",
)(
    lambda v: prepare.with_catalog_metrics(v.catalog).select(
        "item_nbr", "margin_dollars", "margin_percent", "price_segment", "is_active", "is_national_brand", "is_private_label"
    )
)
query(
    "fill_unknown",
    "B9",
    "select item_nbr, coalesce(brand_type, 'Unknown') as brand_type_clean, coalesce(sbu_desc, 'Unknown') as sbu_desc_clean from catalog",
)(
    lambda v: prepare.fill_unknown(v.catalog, ["brand_type", "sbu_desc", "division_desc"]).select(
        "item_nbr", "brand_type_clean", "sbu_desc_clean"
    )
)
_SALES = "store_nbr, item_nbr, wm_yr_wk_nbr, sales_to_inventory_ratio, total_inventory, has_sales, sales_category, inventory_status, year, week"
query("sales_metrics", "B6 B7 B10 B11 B12 B13", f"select {_SALES} from sales_m", "sales_to_inventory_ratio:6 year,week:i")(
    lambda v: prepare.with_sales_metrics(v.weekly_sales).select(*_SALES.split(", "))
)
_PRICE = "store_nbr, item_nbr, price_date, gap_reg_live, discount_pct, on_promotion"
query("price_metrics", "B14 B15", f"select {_PRICE} from price_m", "gap_reg_live,discount_pct:7")(
    lambda v: prepare.with_price_metrics(v.store_price).select(*_PRICE.split(", "))
)
query(
    "competitor_gap",
    "B16",
    "select store_nbr, item_nbr, price_date, live_price_amt * (0.9e0 + 0.01e0 * ((item_nbr * 7 + store_nbr * 13) % 21)) as competitor_price, "
    "live_price_amt - live_price_amt * (0.9e0 + 0.01e0 * ((item_nbr * 7 + store_nbr * 13) % 21)) as gap_live_comp from store_price",
)(
    lambda v: prepare.with_competitor_price(v.store_price).select(
        "store_nbr", "item_nbr", "price_date", "competitor_price", "gap_live_comp"
    )
)
query(
    "calendar_parts",
    "B17 B18",
    "select cast(month(price_date) as int) as month, dayname(price_date) as day_name, cast(cast(round(live_price_amt * 100) as bigint) % 100 as int) as price_cents, "
    "count(*) as n from store_price group by 1, 2, 3",
    "month,price_cents:i",
)(
    lambda v: prepare.with_calendar_parts(v.store_price).groupBy("month", "day_name", "price_cents").agg(F.count("*").alias("n"))
)
query(
    "week_codes",
    "B13 B20 B22",
    "select distinct wm_wk_nbr, wm_wk_nbr + 190000 as week, cast(wm_wk_nbr % 52 as int) as cycle, cast((wm_wk_nbr - 1) % 52 + 1 as int) as cycle_one, "
    "concat('1', substring(cast(wm_wk_nbr + 190000 as varchar), 3, 2), substring(cast(wm_wk_nbr + 190000 as varchar), 5, 2)) as week_text from store_price",
)(
    lambda v: v.store_price.select("wm_wk_nbr")
    .distinct()
    .select(
        "wm_wk_nbr",
        (F.col("wm_wk_nbr") + cols.WEEK_SHIFT).alias("week"),
        cols.cycle_week(F.col("wm_wk_nbr")).alias("cycle"),
        cols.cycle_week(F.col("wm_wk_nbr"), one_based=True).alias("cycle_one"),
        cols.short_week_text(F.col("wm_wk_nbr") + cols.WEEK_SHIFT).alias("week_text"),
    )
)
query(
    "display_names",
    "B27",
    "select store_nbr as \"Store\", item_nbr as \"Item Number\", wkly_qty as \"Weekly Units\" from weekly_sales",
)(
    lambda v: prepare.display_names(
        v.weekly_sales, {"store_nbr": "Store", "item_nbr": "Item Number", "wkly_qty": "Weekly Units"}
    )
)
_SCALED = ["base_unit_retail_amt", "comp_reg", "comp_live", "reg_price_gap"]
query(
    "min_max_scaled",
    "B34 B36",
    "with c as (select * from instore where " + " and ".join(f"{c} is not null" for c in _SCALED) + "), e as (select "
    + ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _SCALED)
    + " from c) select hg_store_id, item_nbr, wm_week, "
    + ", ".join(f"({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0) as {c}" for c in _SCALED)
    + " from c, e",
    ",".join(_SCALED) + ":8",
)(
    lambda v: prepare.min_max_scaled(
        v.instore.dropna(subset=_SCALED).select("hg_store_id", "item_nbr", "wm_week", *_SCALED), _SCALED
    )
)
