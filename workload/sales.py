"""Weekly sales and inventory queries."""

from aislemetrics.operators import prepare, sales
from workload.quality import DESCRIBE_ROUNDS, describe_sql
from workload.registry import query


def m(v):
    return prepare.with_sales_metrics(v.weekly_sales)


WEEK = "(select wm_yr_wk_nbr, sum(wkly_sales_amt) as value from sales_m group by 1)"
ITEM = (
    "(select item_nbr, sum(wkly_sales_amt) as revenue, sum(wkly_qty) as units, "
    "coalesce(stddev_samp(wkly_sales_amt) / nullif(avg(wkly_sales_amt), 0), 0) as cv from sales_m group by 1)"
)


def ends(inner, measure, keys, low, high=None):
    return (
        f"with p as ({inner}) (select *, 'lowest' as side from p where {measure} is not null order by {measure}, {keys} limit {low}) "
        f"union all (select *, 'highest' as side from p where {measure} is not null order by {measure} desc, {keys} limit {high or low})"
    )


_OVERVIEW = (
    "select (select count(distinct store_nbr) from sales_m) as stores, (select count(distinct item_nbr) from sales_m) as items, "
    "count(*) as weeks, min(wm_yr_wk_nbr) as first_week, max(wm_yr_wk_nbr) as last_week, sum(value) as revenue, "
    f"avg(value) as avg_weekly_revenue from {WEEK}"
)
query("business_overview", "J40 D2 D19", _OVERVIEW, "revenue:2 avg_weekly_revenue:5")(
    lambda v: sales.business_overview(m(v))
)
query("sales_describe", "J41 D16", describe_sql(["wkly_sales_amt", "wkly_qty"], "sales_m"), DESCRIBE_ROUNDS)(
    lambda v: sales.sales_overview(m(v))
)
query(
    "sales_split",
    "J41 D6",
    "select s as with_sales, n - s as without_sales, 100e0 * s / n as with_sales_pct, 100e0 * (n - s) / n as without_sales_pct "
    "from (select count(*) as n, count(*) filter (has_sales) as s from sales_m)",
    "with_sales_pct,without_sales_pct:6",
)(lambda v: sales.sales_split(m(v)))
query("inventory_describe", "J42 D16", describe_sql(["onhand_invt_qty", "in_trnst_invt_qty"], "sales_m"), DESCRIBE_ROUNDS)(
    lambda v: sales.inventory_overview(m(v))
)
query(
    "stock_split",
    "J42",
    "select i as in_stock, o as out_of_stock, 100e0 * i / n as in_stock_pct, 100e0 * o / n as out_of_stock_pct from "
    "(select count(*) as n, count(*) filter (onhand_invt_qty > 0) as i, count(*) filter (onhand_invt_qty = 0) as o from sales_m)",
    "in_stock_pct,out_of_stock_pct:6",
)(lambda v: sales.stock_split(m(v)))
for _name, _col, _round in (("top_stores_by_sales", "wkly_sales_amt", "total:2"), ("top_stores_by_inventory", "onhand_invt_qty", "total:i")):
    query(
        _name,
        "J41 J42 F2",
        f"select store_nbr, sum({_col}) as total from sales_m where store_nbr is not null group by 1 order by total desc, 1 limit 5",
        _round,
    )(lambda v, col=_col: sales.top_stores(m(v), col))

_STORE = (
    "select store_nbr, sum(wkly_sales_amt) as revenue, avg(wkly_sales_amt) as avg_sales, stddev_samp(wkly_sales_amt) as std_sales, "
    "count(wkly_sales_amt) as records, sum(wkly_qty) as units, avg(wkly_qty) as avg_units, avg(onhand_invt_qty) as avg_inventory "
    "from sales_m where store_nbr is not null group by 1"
)
query("store_performance", "J43 D1", _STORE, "revenue,units:2 avg_sales,std_sales,avg_units,avg_inventory:5")(
    lambda v: sales.store_performance(m(v))
)
query("store_ranking", "J43 F2", ends(f"select store_nbr, revenue from ({_STORE})", "revenue", "store_nbr", 5, 10), "revenue:2")(
    lambda v: sales.store_ranking(m(v))
)
query("store_consistency", "J44 D21", ends(f"select store_nbr, std_sales / nullif(avg_sales, 0) as cv from ({_STORE})", "cv", "store_nbr", 5), "cv:7")(
    lambda v: sales.store_consistency(m(v))
)
query(
    "store_summary_stats",
    "J45 D24",
    "select count(*) as stores, avg(revenue) as mean, min(revenue) as min, max(revenue) as max, stddev_samp(revenue) as std, "
    f"max(revenue) / nullif(min(revenue), 0) as max_to_min from ({_STORE})",
    "min,max:2 mean,std:4 max_to_min:7",
)(lambda v: sales.store_summary_stats(m(v)))
_PRODUCT = (
    "select item_nbr, sum(wkly_sales_amt) as revenue, avg(wkly_sales_amt) as avg_sales, count(wkly_sales_amt) as records, "
    "sum(wkly_qty) as units, avg(wkly_qty) as avg_units, avg(onhand_invt_qty) as avg_inventory from sales_m where item_nbr is not null group by 1"
)
query("product_performance", "J46", _PRODUCT, "revenue,units:2 avg_sales,avg_units,avg_inventory:5")(
    lambda v: sales.product_performance(m(v))
)
query(
    "product_ranking",
    "J46 F2 B35",
    f"(select item_nbr, revenue, 'highest' as side from {ITEM} order by revenue desc, 1 limit 10) union all "
    f"(select item_nbr, revenue, 'lowest' as side from {ITEM} where revenue > 0 order by revenue, 1 limit 10)",
    "revenue:2",
)(lambda v: sales.product_ranking(m(v)))

_ABC = (
    "select item_nbr, revenue, total_value, cum_pct, case when cum_pct <= 80 then 'A' when cum_pct <= 95 then 'B' else 'C' end as abc_class from ("
    "select item_nbr, revenue, sum(revenue) over () as total_value, "
    f"100e0 * sum(revenue) over (order by revenue desc, item_nbr rows unbounded preceding) / sum(revenue) over () as cum_pct from {ITEM})"
)
_XYZ = (
    f"with i as {ITEM} select item_nbr, cv, case when cv <= (select quantile_cont(cv, 0.33) from i) then '{{0}}' "
    "when cv <= (select quantile_cont(cv, 0.67) from i) then '{1}' else '{2}' end as {3} from i"
)
query("abc_classes", "J47 E3", _ABC, "revenue,total_value:2 cum_pct:6")(lambda v: sales.abc_classes(m(v)))
query("xyz_classes", "J48 D15 D21", _XYZ.format("X", "Y", "Z", "xyz_class"), "cv:7")(lambda v: sales.xyz_classes(m(v)))
query(
    "abc_xyz_matrix",
    "J49 C12",
    f"select *, case when abc_xyz = 'AX' then 'Key products - maintain high service levels' "
    "when abc_xyz = 'AY' then 'Important but variable - improve forecasting' "
    "when abc_xyz = 'AZ' then 'High value, unpredictable - safety stock strategy' "
    "when abc_xyz like 'B%' then 'Medium importance - standard management' "
    "else 'Low priority - consider discontinuation' end as strategy from ("
    "select abc_class || xyz_class as abc_xyz, count(*) as products, sum(revenue) as revenue, "
    f"100e0 * sum(revenue) / max(total_value) as revenue_pct from ({_ABC}) a join ({_XYZ.format('X', 'Y', 'Z', 'xyz_class')}) x using (item_nbr) group by 1)",
    "revenue:2 revenue_pct:6",
)(lambda v: sales.abc_xyz_matrix(m(v)))
query(
    "velocity_classes",
    "J50",
    f"with i as {ITEM} select item_nbr, units, case when units > (select quantile_cont(units, 0.5) from i) then 'fast' else 'slow' end as velocity from i",
    "units:2",
)(lambda v: sales.velocity_classes(m(v)))
query(
    "weekly_performance",
    "J51 A5",
    "select wm_yr_wk_nbr, sum(wkly_sales_amt) as revenue, avg(wkly_sales_amt) as avg_sales, count(wkly_sales_amt) as records, "
    "sum(wkly_qty) as units, avg(onhand_invt_qty) as avg_inventory from sales_m group by 1",
    "revenue,units:2 avg_sales,avg_inventory:5",
)(lambda v: sales.weekly_performance(m(v)))


def growth_sql(keys=""):
    part = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return (
        f"select {lead}avg(growth) as avg_growth_pct, stddev_samp(growth) as growth_std_pct, "
        "first(wm_yr_wk_nbr order by value desc, wm_yr_wk_nbr) as best_week, max(value) as best_revenue, "
        "first(wm_yr_wk_nbr order by value, wm_yr_wk_nbr) as worst_week, min(value) as worst_revenue from ("
        f"select *, (value - lag(value) over w) / nullif(lag(value) over w, 0) * 100 as growth from "
        f"(select {lead}wm_yr_wk_nbr, sum(wkly_sales_amt) as value from sales_m group by all) window w as ({part} order by wm_yr_wk_nbr)) "
        + (f"group by {keys}" if keys else "")
    )


GROWTH_ROUNDS = "avg_growth_pct,growth_std_pct:5 best_revenue,worst_revenue:2"
query("growth_analysis", "J52 E4 D18", growth_sql(), GROWTH_ROUNDS)(lambda v: sales.growth_analysis(m(v)))
query("growth_by_store", "J52", growth_sql("store_nbr"), GROWTH_ROUNDS)(lambda v: sales.growth_analysis(m(v), ["store_nbr"]))
_SEASON = "(select week, sum(wkly_sales_amt) as value from sales_m group by 1)"
query(
    "seasonal_sales",
    "J53",
    "select first(week order by value desc, week) as peak_week, first(week order by value, week) as low_week, "
    f"(max(value) / nullif(min(value), 0) - 1) * 100 as variation_pct from {_SEASON} having (select count(*) from {WEEK}) >= 50",
    "variation_pct:5",
)(lambda v: sales.seasonal_sales(m(v)))
query(
    "inventory_efficiency",
    "J54",
    ends("select store_nbr, sum(wkly_sales_amt) / nullif(avg(onhand_invt_qty), 0) as efficiency from sales_m group by 1", "efficiency", "store_nbr", 5),
    "efficiency:4",
)(lambda v: sales.inventory_efficiency(m(v)))


def rate_sql(name, condition):
    return (
        f"select *, avg({name}_rate) over () as average_rate from (select store_nbr, count(*) filter ({condition}) as {name}_count, "
        f"count(*) as records, 100e0 * count(*) filter ({condition}) / count(*) as {name}_rate from sales_m group by 1)"
    )


query("stockout_rate", "J55 D6 I4", rate_sql("stockout", "onhand_invt_qty = 0"), "stockout_rate,average_rate:6")(
    lambda v: sales.stockout_rate(m(v))
)
query(
    "stockout_rate_worst",
    "J55",
    f"select * from ({rate_sql('stockout', 'onhand_invt_qty = 0')}) order by stockout_rate desc, store_nbr limit 5",
    "stockout_rate,average_rate:6",
)(lambda v: sales.stockout_rate(m(v), worst=5))
query(
    "overstock_rate",
    "J56 D15",
    rate_sql("overstock", "onhand_invt_qty > (select quantile_cont(onhand_invt_qty, 0.75) from sales_m)"),
    "overstock_rate,average_rate:6",
)(lambda v: sales.overstock_rate(m(v)))
query(
    "efficiency_quartiles",
    "J57 E8",
    "with d as (select * from sales_m where wkly_sales_amt > 0 and onhand_invt_qty > 0), "
    "q as (select quantile_cont(sales_to_inventory_ratio, 0.25) as a, quantile_cont(sales_to_inventory_ratio, 0.5) as b, "
    "quantile_cont(sales_to_inventory_ratio, 0.75) as c from d) "
    "select case when sales_to_inventory_ratio <= a then 'Low Efficiency' when sales_to_inventory_ratio <= b then 'Medium-Low' "
    "when sales_to_inventory_ratio <= c then 'Medium-High' else 'High Efficiency' end as quartile, avg(wkly_sales_amt) as avg_sales, "
    "count(wkly_sales_amt) as records, avg(onhand_invt_qty) as avg_inventory, avg(sales_to_inventory_ratio) as avg_ratio from d, q group by 1",
    "avg_sales,avg_inventory,avg_ratio:5",
)(lambda v: sales.efficiency_quartiles(m(v)))
query(
    "store_efficiency_ranking",
    "J58",
    ends("select store_nbr, avg(sales_to_inventory_ratio) as avg_ratio from sales_m where wkly_sales_amt > 0 and onhand_invt_qty > 0 group by 1", "avg_ratio", "store_nbr", 5),
    "avg_ratio:5",
)(lambda v: sales.store_efficiency_ranking(m(v)))
_TURN = "select store_nbr, item_nbr, sum(wkly_qty) / (avg(onhand_invt_qty) + 0.1e0) as turnover from sales_m group by 1, 2"
query("turnover_summary", "J59", f"select count(*) as pairs, avg(turnover) as avg_turnover, quantile_cont(turnover, 0.5) as median_turnover from ({_TURN})", "avg_turnover,median_turnover:6")(
    lambda v: sales.turnover_summary(m(v))
)
query("inventory_turnover", "J59", _TURN, "turnover:6")(lambda v: sales.inventory_turnover(m(v)))
query("turnover_extremes", "J59", ends(_TURN, "turnover", "store_nbr, item_nbr", 10), "turnover:6")(
    lambda v: sales.turnover_extremes(m(v))
)
_SERVICE = (
    "select store_nbr, item_nbr, count(*) filter (onhand_invt_qty = 0) as stockouts, count(onhand_invt_qty) as periods, "
    "(1 - count(*) filter (onhand_invt_qty = 0)::double / nullif(count(onhand_invt_qty), 0)) * 100 as service_level from sales_m group by 1, 2"
)
query("service_level", "J60", _SERVICE, "service_level:6")(lambda v: sales.service_level(m(v)))
query("service_summary", "J60", f"select avg(service_level) as avg_service_level, count(*) filter (service_level < 90) as low_service_pairs from ({_SERVICE})", "avg_service_level:6")(
    lambda v: sales.service_summary(m(v))
)
query(
    "inventory_kpis",
    "J61",
    "select store_nbr, sum(wkly_sales_amt) as revenue, avg(wkly_sales_amt) as avg_sales, avg(onhand_invt_qty) as avg_inventory, "
    "stddev_samp(onhand_invt_qty) as std_inventory, count(*) filter (onhand_invt_qty = 0) as stockouts, "
    "sum(wkly_sales_amt) / nullif(avg(onhand_invt_qty), 0) as turnover, "
    "1 - count(*) filter (onhand_invt_qty = 0)::double / count(*) as service_level from sales_m group by 1",
    "revenue:2 avg_sales,avg_inventory,std_inventory,turnover:4 service_level:7",
)(lambda v: sales.inventory_kpis(m(v)))
query(
    "lifecycle_stage",
    "J62 E9",
    "select item_nbr, case when b > a * 1.2e0 then 'Growth' when b < a * 0.8e0 then 'Decline' else 'Mature' end as stage, total_sales, "
    "case when a > 0 then b / a else 1 end as trend_ratio from (select item_nbr, avg(value) filter (rn <= n // 2) as a, "
    "avg(value) filter (rn > n // 2) as b, sum(value) as total_sales from (select *, count(*) over (partition by item_nbr) as n, "
    "row_number() over (partition by item_nbr order by wm_yr_wk_nbr) as rn from "
    "(select item_nbr, wm_yr_wk_nbr, sum(wkly_sales_amt) as value from sales_m group by 1, 2)) where n >= 8 group by 1)",
    "total_sales:2 trend_ratio:6",
)(lambda v: sales.lifecycle_stage(m(v)))
query(
    "demand_variability",
    "J63 I2",
    _XYZ.format("Predictable", "Variable", "Highly Variable", "variability_class"),
    "cv:7",
)(lambda v: sales.demand_variability(m(v)))
query(
    "demand_characteristics",
    "J64",
    "select count(*) as weeks, avg(value) as mean_demand, stddev_samp(value) as std_demand, "
    f"stddev_samp(value) / nullif(avg(value), 0) as cv from {WEEK} having count(*) >= 12",
    "mean_demand,std_demand:4 cv:7",
)(lambda v: sales.demand_characteristics(m(v)))
query(
    "seasonal_cv",
    "J65",
    "select stddev_samp(value) / nullif(avg(value), 0) as seasonal_cv, first(week order by value desc, week) as peak_week, "
    f"first(week order by value, week) as low_week from {_SEASON}",
    "seasonal_cv:7",
)(lambda v: sales.seasonal_cv(m(v)))


def proxy_sql(keys=""):
    part = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return (
        f"select *, abs(recent_avg - historical_avg) / nullif(historical_avg, 0) * 100 as deviation_pct from (select {lead}max(n) as weeks, "
        "avg(value) filter (rn > n - 8) as recent_avg, avg(value) filter (rn <= 12) as historical_avg from (select *, "
        f"row_number() over ({part} order by wm_yr_wk_nbr) as rn, count(*) over ({part}) as n from "
        f"(select {lead}wm_yr_wk_nbr, sum(wkly_sales_amt) as value from sales_m group by all)) group by all) where weeks >= 20"
    )


query("forecast_proxy", "J66 E10", proxy_sql(), "recent_avg,historical_avg:7 deviation_pct:6")(lambda v: sales.forecast_proxy(m(v)))
query("forecast_proxy_by_store", "J66", proxy_sql("store_nbr"), "recent_avg,historical_avg:7 deviation_pct:6")(
    lambda v: sales.forecast_proxy(m(v), by=["store_nbr"])
)
_TOP20 = (
    "select count(*) filter (rn <= floor(n * 0.2e0)) as top_items, 100e0 * sum(revenue) filter (rn <= floor(n * 0.2e0)) / sum(revenue) as top_share_pct "
    f"from (select *, row_number() over (order by revenue desc, item_nbr) as rn, count(*) over () as n from {ITEM})"
)
query("top_pct_share", "J67", _TOP20, "top_share_pct:6")(lambda v: sales.top_pct_share(m(v)))
query(
    "sales_report",
    "J68",
    "select *, concat_ws('; ', case when stockout_rate_pct > 10 then 'High stockout rate detected - review inventory planning' "
    "when stockout_rate_pct < 2 then 'Very low stockout rate - consider inventory reduction' end, "
    "case when stores > 5 then 'Multi-store network - implement store benchmarking program' end, "
    "case when items > 1000 then 'Large product portfolio - consider ABC analysis for optimization' end) as recommendations from ("
    f"select o.*, s.*, l.*, t.top_share_pct as top_20pct_share from ({_OVERVIEW}) o, "
    f"(select first(store_nbr order by revenue desc, store_nbr) as top_store, max(revenue) as top_store_revenue from ({_STORE})) s, "
    "(select sum(wkly_qty) as units, avg(onhand_invt_qty) as avg_inventory, 100e0 * count(*) filter (onhand_invt_qty = 0) / count(*) as stockout_rate_pct, "
    f"avg(sales_to_inventory_ratio) as avg_ratio from sales_m) l, ({_TOP20}) t)",
    "revenue,top_store_revenue,units:2 avg_weekly_revenue,avg_inventory,avg_ratio:4 stockout_rate_pct,top_20pct_share:6",
)(lambda v: sales.sales_report(m(v)))
