"""Store price queries."""

from aislemetrics.operators import prepare, pricing, quality
from workload.quality import BOX_ROUNDS, DESCRIBE_ROUNDS, box_sql, describe_sql
from workload.registry import query
from workload.sales import ends


def m(v):
    return prepare.with_price_metrics(v.store_price)


def _mix(column):
    return (
        f"select {column}, count(*) as n, 100e0 * count(*) / (select count(*) from price_m) as pct from price_m "
        f"where {column} is not null group by 1"
    )


query(
    "geo_coverage",
    "J70 D3 D5",
    f"select * from ({_mix('prov_cd')}) join (select prov_cd, count(distinct store_nbr) as stores from price_m group by 1) using (prov_cd)",
    "pct:6",
)(lambda v: pricing.geo_coverage(m(v)))
query("region_records", "J70", _mix("region_nm"), "pct:6")(lambda v: pricing.region_records(m(v)))
query(
    "pricing_overview",
    "J71 D16",
    describe_sql(["live_price_amt", "defined_reg_price_amt", "gap_reg_live"], "price_m"),
    DESCRIBE_ROUNDS,
)(lambda v: pricing.pricing_overview(m(v)))
query(
    "promotion_rate",
    "J71 D7 B15",
    "select 100e0 * count(*) filter (on_promotion) / count(*) as promo_rate_pct from price_m",
    "promo_rate_pct:7",
)(lambda v: pricing.promotion_rate(m(v)))
_STATS = (
    "avg(live_price_amt) as avg_price, stddev_samp(live_price_amt) as std_price, count(live_price_amt) as records, "
    "avg(gap_reg_live) as avg_gap, avg(on_promotion::int) as promo_rate"
)
STATS_ROUNDS = "avg_price,std_price,avg_gap,promo_rate:7"
query(
    "province_stats",
    "J72 D1",
    f"select prov_cd, {_STATS}, quantile_cont(live_price_amt, 0.5) as median_price from price_m where prov_cd is not null group by 1",
    STATS_ROUNDS + " median_price:7",
)(lambda v: pricing.province_stats(m(v)))
query("weekly_price_stats", "J73", f"select wm_wk_nbr, {_STATS} from price_m group by 1", STATS_ROUNDS)(
    lambda v: pricing.weekly_price_stats(m(v))
)
query("promo_split", "J74", _mix("on_promotion"), "pct:7")(lambda v: pricing.promo_split(m(v)))
_RATE = "select {0}, 100e0 * avg(on_promotion::int) as promo_rate_pct from price_m where {0} is not null group by 1"
query("promo_rate_by_province", "J75", _RATE.format("prov_cd"), "promo_rate_pct:7")(
    lambda v: pricing.promo_rate_by(m(v), "prov_cd")
)
query("promo_rate_by_week", "J75 D7", _RATE.format("wm_wk_nbr"), "promo_rate_pct:7")(
    lambda v: pricing.promo_rate_by(m(v), "wm_wk_nbr")
)
query(
    "promo_extremes",
    "J75 D18",
    "select first(wm_wk_nbr order by promo_rate_pct desc, wm_wk_nbr) as peak, max(promo_rate_pct) as peak_rate_pct, "
    "first(wm_wk_nbr order by promo_rate_pct, wm_wk_nbr) as low, min(promo_rate_pct) as low_rate_pct, "
    f"stddev_samp(promo_rate_pct) as std_pct from ({_RATE.format('wm_wk_nbr')})",
    "peak_rate_pct,low_rate_pct,std_pct:7",
)(lambda v: pricing.promo_extremes(m(v)))
query(
    "discount_comparison",
    "J76",
    "select on_promotion, avg(gap_reg_live) as avg_gap, count(gap_reg_live) as records from price_m group by 1",
    "avg_gap:7",
)(lambda v: pricing.discount_comparison(m(v)))
_STORE = (
    f"select store_nbr, {_STATS}, count(distinct item_nbr) as items from price_m where store_nbr is not null group by 1"
)
query("store_price_stats", "J77", _STORE, STATS_ROUNDS)(lambda v: pricing.store_price_stats(m(v)))
for _by in ("records", "items"):
    query(f"largest_stores_by_{_by}", "J77 F2", f"select * from ({_STORE}) order by {_by} desc, store_nbr limit 10", STATS_ROUNDS)(
        lambda v, by=_by: pricing.largest_stores(m(v), by)
    )
query("store_price_rank", "J78 F4", ends("select store_nbr, avg(live_price_amt) as avg_price from price_m group by 1", "avg_price", "store_nbr", 5), "avg_price:7")(
    lambda v: pricing.store_price_rank(m(v))
)
query(
    "store_price_consistency",
    "J79",
    "select store_nbr, stddev_samp(live_price_amt) as std_price from price_m group by 1 order by 2, 1 limit 5",
    "std_price:7",
)(lambda v: pricing.store_price_consistency(m(v)))
query(
    "regional_gradient",
    "J80",
    "select max(p) - min(p) as price_range, first(region_nm order by p, region_nm) as lowest_region, min(p) as lowest_price, "
    "first(region_nm order by p desc, region_nm) as highest_region, max(p) as highest_price from "
    "(select region_nm, avg(live_price_amt) as p from price_m where region_nm is not null group by 1)",
    "price_range,lowest_price,highest_price:7",
)(lambda v: pricing.regional_gradient(m(v)))
_STRATEGY = (
    "with s as (select store_nbr, round(avg(live_price_amt), 3) as avg_price, round(avg(on_promotion::int), 3) as promo_rate, "
    "round(avg(gap_reg_live), 3) as avg_gap from price_m group by 1), "
    "q as (select quantile_cont(avg_price, 0.5) as p, quantile_cont(promo_rate, 0.5) as r from s) "
    "select s.*, case when avg_price > p and promo_rate <= r then 'Premium' when avg_price <= p and promo_rate <= r then 'EDLP' "
    "when avg_price > p and promo_rate > r then 'Hi-Lo' else 'Discount' end as strategy from s, q"
)
query("pricing_strategy", "J81", _STRATEGY, "avg_price,promo_rate,avg_gap:3")(lambda v: pricing.pricing_strategy(m(v)))
query(
    "strategy_performance",
    "J81",
    "select strategy, count(*) as stores, 100e0 * count(*) / sum(count(*)) over () as stores_pct, avg(avg_price) as avg_price, "
    f"avg(promo_rate) as promo_rate, avg(avg_gap) as avg_gap from ({_STRATEGY}) group by 1",
    "stores_pct,avg_price,promo_rate,avg_gap:6",
)(lambda v: pricing.strategy_performance(pricing.pricing_strategy(m(v))))
_ITEM = "select item_nbr, stddev_samp(live_price_amt) / nullif(avg(live_price_amt), 0) as cv from price_m group by 1"
query(
    "price_consistency_by_item",
    "J82 D21",
    f"select e.*, (select avg(cv) from ({_ITEM})) as avg_cv from ({ends(_ITEM, 'cv', 'item_nbr', 5)}) e",
    "cv,avg_cv:7",
)(lambda v: pricing.price_consistency_by_item(m(v)))
_CYCLE = "select cast(wm_wk_nbr % 52 as int) as season_week, 100e0 * avg(on_promotion::int) as promo_rate_pct from price_m group by 1"
query("seasonal_promotion", "J83 B20", _CYCLE, "promo_rate_pct:7")(lambda v: pricing.seasonal_promotion(m(v)))
query("seasonal_promotion_extremes", "J83 F2", ends(_CYCLE, "promo_rate_pct", "season_week", 5), "promo_rate_pct:7")(
    lambda v: pricing.seasonal_promotion_extremes(m(v))
)
_VOL = (
    "select item_nbr, avg(live_price_amt) as avg_price, stddev_samp(live_price_amt) as std_price, count(live_price_amt) as records, "
    "coalesce(stddev_samp(live_price_amt) / nullif(avg(live_price_amt), 0), 0) as cv from price_m group by 1 having count(live_price_amt) > 5"
)
query("product_volatility", "J84", _VOL, "avg_price,std_price,cv:7")(lambda v: pricing.product_volatility(m(v)))
query("volatility_extremes", "J84 F2", ends(_VOL, "cv", "item_nbr", 10), "avg_price,std_price,cv:7")(
    lambda v: pricing.volatility_extremes(m(v))
)
query(
    "category_analysis",
    "J85 B19 I3",
    "select case item_nbr % 5 when 0 then 'Electronics' when 1 then 'Groceries' when 2 then 'Apparel' when 3 then 'Home Goods' else 'Toys' end as product_category, "
    "avg(live_price_amt) as avg_price, 100e0 * avg(on_promotion::int) as promo_rate_pct, avg(gap_reg_live) as avg_gap, "
    "count(distinct item_nbr) as items from price_m group by 1",
    "avg_price,promo_rate_pct,avg_gap:7",
)(lambda v: pricing.category_analysis(m(v)))
query(
    "pricing_report",
    "J86",
    "with p as (select prov_cd, avg(live_price_amt) as p from price_m where prov_cd is not null group by 1) "
    "select b.*, h.* from (select count(*) as records, count(distinct item_nbr) as items, count(distinct store_nbr) as stores, "
    "count(distinct wm_wk_nbr) as weeks, count(distinct prov_cd) as provinces, avg(live_price_amt) as avg_price, "
    "max(live_price_amt) - min(live_price_amt) as price_range, 100e0 * avg(on_promotion::int) as promo_rate_pct, "
    "min(wm_wk_nbr) as first_week, max(wm_wk_nbr) as last_week from price_m) b, "
    "(select first(prov_cd order by p desc, prov_cd) as highest_province, max(p) as highest_price, "
    "first(prov_cd order by p, prov_cd) as lowest_province, min(p) as lowest_price from p) h",
    "avg_price,price_range,promo_rate_pct,highest_price,lowest_price:6",
)(lambda v: pricing.pricing_report(m(v)))
query(
    "region_price_series",
    "J73",
    "select *, avg(value) over (partition by region_nm) as series_avg from (select region_nm, wm_wk_nbr, avg(live_price_amt) as value "
    "from price_m where region_nm is not null group by 1, 2)",
    "value,series_avg:7",
)(lambda v: pricing.price_series(m(v), by=("region_nm",)))
query("price_box_by_store", "J14", box_sql("store_nbr", "live_price_amt", "price_m"), BOX_ROUNDS)(
    lambda v: quality.box_stats(v.store_price, "store_nbr", "live_price_amt")
)
