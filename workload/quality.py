"""Profiling and data-quality queries."""

from aislemetrics.operators import prepare, quality
from workload.registry import query

CATALOG_NUMBERS = ["base_unit_retail_amt", "cost"]
SALES_NUMBERS = ["wkly_sales_amt", "wkly_qty", "onhand_invt_qty", "in_trnst_invt_qty"]
PRICE_NUMBERS = ["live_price_amt", "defined_reg_price_amt", "competitor_price_amt"]

CATALOG_COLUMNS = (
    "item_nbr old_nbr upc sbu_nbr sbu_desc dept_nbr dept_desc dept_category_nbr dept_category_desc "
    "dept_subcatg_desc hg_iv_id var_long_desc brand_name brand_type vendor_name country_name "
    "item_status_code base_unit_retail_amt cost"
).split()
INSTORE_COLUMNS = (
    "hg_store_id hg_region wm_week item_nbr upc_nbr brand_type banner_name base_unit_retail_amt comp_reg "
    "comp_live equalization_factor reg_price_gap item_win item_draw item_loss"
).split()


def _each(columns, cells, table):
    return " union all ".join(
        f"select '{c}' as \"column\", {cells.format(c=c)} from {table}" for c in columns
    )


MISSING = "count(*) - count({c}) as missing_count, (count(*) - count({c})) * 100e0 / count(*) as missing_pct"

query("missing_summary", "J1", _each(INSTORE_COLUMNS, MISSING, "instore"), "missing_pct:6")(
    lambda v: quality.missing_summary(v.instore)
)
query(
    "missing_summary_top",
    "J1",
    f"select * from ({_each(CATALOG_COLUMNS, MISSING, 'catalog')}) where missing_count > 0 "
    "order by missing_count desc, \"column\" limit 15",
    "missing_pct:6",
)(lambda v: quality.missing_summary(v.catalog, only_missing=True, top=15))
query(
    "field_completeness",
    "J2",
    _each(["dept_desc", "vendor_name", "brand_name", "base_unit_retail_amt", "cost", "brand_type"],
          "100e0 * count({c}) / count(*) as complete_pct", "catalog"),
    "complete_pct:6",
)(
    lambda v: quality.field_completeness(
        v.catalog,
        ["item_description", "dept_desc", "vendor_name", "brand_name", "base_unit_retail_amt", "cost", "brand_type"],
    )
)
query(
    "table_completeness",
    "J3",
    "select 100e0 * (" + " + ".join(f"count({c})" for c in INSTORE_COLUMNS)
    + f") / (count(*) * {len(INSTORE_COLUMNS)}) as completeness_pct from instore",
    "completeness_pct:6",
)(lambda v: quality.table_completeness(v.instore))
query(
    "duplicate_rows",
    "J4 G3",
    "select n as rows, d as distinct_rows, n - d as duplicates from "
    "(select count(*) as n from instore) a, (select count(*) as d from (select distinct * from instore)) b",
    "rows,distinct_rows,duplicates:i",
)(lambda v: quality.duplicate_report(v.instore))
query(
    "duplicate_keys",
    "J4 G4",
    "select n as rows, d as distinct_rows, n - d as duplicates from (select count(*) as n from weekly_sales) a, "
    "(select count(*) as d from (select distinct store_nbr, item_nbr, wm_yr_wk_nbr from weekly_sales)) b",
    "rows,distinct_rows,duplicates:i",
)(lambda v: quality.duplicate_report(v.weekly_sales, ["store_nbr", "item_nbr", "wm_yr_wk_nbr"]))
query(
    "invalid_value_counts",
    "J5",
    _each(["wkly_sales_amt", "wkly_qty", "onhand_invt_qty"],
          "count(*) filter ({c} < 0) as negatives, count(*) filter ({c} = 0) as zeros", "weekly_sales"),
)(lambda v: quality.invalid_value_counts(v.weekly_sales, ["wkly_sales_amt", "wkly_qty", "onhand_invt_qty"]))
query(
    "extreme_margin_count",
    "J6",
    "select count(*) filter (margin_percent < -100 or margin_percent > 100) as extreme_margins from catalog_m",
)(lambda v: quality.extreme_margin_count(prepare.with_catalog_metrics(v.catalog)))
query(
    "sales_without_inventory",
    "J7",
    "select count(*) filter (wkly_sales_amt > 0 and onhand_invt_qty = 0) as sales_without_inventory from weekly_sales",
)(lambda v: quality.sales_without_inventory(v.weekly_sales))
query(
    "sigma_outliers",
    "J8",
    "select * from ("
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) filter (abs({c} - (select avg({c}) from instore)) > "
        f"3 * (select stddev_samp({c}) from instore)) as outliers from instore"
        for c in ["base_unit_retail_amt", "comp_reg", "comp_live", "reg_price_gap"]
    )
    + ") where outliers > 0",
)(lambda v: quality.sigma_outliers(v.instore, ["base_unit_retail_amt", "comp_reg", "comp_live", "reg_price_gap"]))
query(
    "dataset_overview",
    "J9",
    "select count(*) as rows, 8 as columns, count(distinct store_nbr) as distinct_store_nbr, "
    "count(distinct item_nbr) as distinct_item_nbr, count(distinct wm_yr_wk_nbr) as distinct_wm_yr_wk_nbr, "
    "min(wm_yr_wk_nbr) as first_period, max(wm_yr_wk_nbr) as last_period from weekly_sales",
    "columns:i",
)(lambda v: quality.dataset_overview(v.weekly_sales, ["store_nbr", "item_nbr", "wm_yr_wk_nbr"], "wm_yr_wk_nbr"))


def describe_sql(columns, table):
    cells = (
        "count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min(cast({c} as double)) as min, "
        "max(cast({c} as double)) as max, quantile_cont(cast({c} as double), 0.25) as q25, "
        "quantile_cont(cast({c} as double), 0.5) as q50, quantile_cont(cast({c} as double), 0.75) as q75"
    )
    return _each(columns, cells, table)


DESCRIBE_ROUNDS = "mean,std,min,max,q25,q50,q75:7"
query("numeric_summary", "J11 D16", describe_sql(SALES_NUMBERS, "weekly_sales"), DESCRIBE_ROUNDS)(
    lambda v: quality.numeric_summary(v.weekly_sales, SALES_NUMBERS)
)
query(
    "category_top",
    "J12",
    "select \"column\", value, n, rank from (select *, row_number() over (partition by \"column\" order by n desc, value) as rank from ("
    + " union all ".join(
        f"select '{c}' as \"column\", {c} as value, count(*) as n from instore where {c} is not null group by {c}"
        for c in ["hg_region", "upc_nbr", "brand_type", "banner_name", "item_win", "item_draw", "item_loss"]
    )
    + ")) where rank <= 5",
)(lambda v: quality.category_top(v.instore))
query(
    "histogram",
    "J13",
    "with e as (select min(wkly_sales_amt) as lo, max(wkly_sales_amt) as hi from weekly_sales) "
    "select bin, n, (select lo from e) + bin * ((select hi - lo from e) / 50) as from_value from ("
    "select cast(least(floor((wkly_sales_amt - lo) / ((hi - lo) / 50)), 49) as int) as bin, count(*) as n "
    "from weekly_sales, e group by 1) x",
    "from_value:5",
)(lambda v: quality.histogram(v.weekly_sales, "wkly_sales_amt", 50))


def box_sql(group, column, table):
    return (
        f"with q as (select {group}, quantile_cont({column}, 0.25) as q25, quantile_cont({column}, 0.5) as median, "
        f"quantile_cont({column}, 0.75) as q75 from {table} where {group} is not null group by {group}) "
        f"select {group}, min({column}) as min, any_value(q25) as q25, any_value(median) as median, "
        f"any_value(q75) as q75, max({column}) as max, "
        f"min({column}) filter (t.{column} >= q25 - 1.5e0 * (q75 - q25)) as whisker_low, "
        f"max({column}) filter (t.{column} <= q75 + 1.5e0 * (q75 - q25)) as whisker_high, "
        f"count(*) filter (t.{column} < q25 - 1.5e0 * (q75 - q25) or t.{column} > q75 + 1.5e0 * (q75 - q25)) as outliers "
        f"from {table} t join q using ({group}) where {column} is not null group by {group}"
    )


BOX_ROUNDS = "min,q25,median,q75,max,whisker_low,whisker_high:7 outliers:i"
query("box_stats", "J14", box_sql("prov_cd", "live_price_amt", "store_price"), BOX_ROUNDS)(
    lambda v: quality.box_stats(v.store_price, "prov_cd", "live_price_amt")
)
query(
    "records_per_key",
    "J15",
    "select store_nbr, count(*) as n from weekly_sales where store_nbr is not null group by 1 order by n desc, store_nbr limit 20",
)(lambda v: quality.records_per_key(v.weekly_sales, "store_nbr", 20))
query(
    "value_counts",
    "D5",
    "select vendor_name, count(*) as n, count(*) * 100e0 / (select count(*) from catalog) as pct from catalog "
    "where vendor_name is not null group by 1",
    "pct:6",
)(lambda v: quality.value_counts(v.catalog, "vendor_name"))
query("distinct_estimates", "D4")(lambda v: quality.distinct_estimates(v.weekly_sales, ["store_nbr", "item_nbr"]))
