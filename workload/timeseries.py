"""Weekly series queries."""

from aislemetrics.operators import prepare, timeseries as ts
from workload.competitive import corr_sql
from workload.registry import query

WEEK = "wm_wk_nbr"


def price(v):
    return ts.series(prepare.with_price_metrics(v.store_price), WEEK, "live_price_amt")


def price_by_store(v):
    return ts.series(prepare.with_price_metrics(v.store_price), WEEK, "live_price_amt", by=["store_nbr"])


def demand(v):
    return ts.series(v.weekly_sales, "wm_yr_wk_nbr", "wkly_sales_amt", how="sum")


def series_sql(key=""):
    lead = f"{key}, " if key else ""
    part = f"partition by {key}" if key else ""
    return (
        f"(select *, row_number() over ({part} order by {WEEK}) - 1 as pos, count(*) over ({part}) as n from "
        f"(select {lead}{WEEK}, avg(live_price_amt) as value from store_price group by all))"
    )


PRICE, BY_STORE = series_sql(), series_sql("store_nbr")
DEMAND = (
    "(select *, row_number() over (order by wm_yr_wk_nbr) - 1 as pos from "
    "(select wm_yr_wk_nbr, sum(wkly_sales_amt) as value from weekly_sales group by 1))"
)
_TREND = "count(value) as weeks, regr_slope(value, pos) as slope, regr_intercept(value, pos) as intercept"
query("price_trend", "J110 E11", f"select {_TREND} from {PRICE} having count(value) >= 20", "slope,intercept:7")(
    lambda v: ts.linear_trend(price(v))
)
query("price_trend_by_store", "J110", f"select store_nbr, {_TREND} from {BY_STORE} group by 1 having count(value) >= 20", "slope,intercept:7")(
    lambda v: ts.linear_trend(price_by_store(v), ["store_nbr"])
)
query("trend_statistics", "J111", f"select {_TREND}, regr_r2(value, pos) as r2 from {DEMAND} having count(value) >= 12", "slope,intercept:5 r2:8")(
    lambda v: ts.trend_test(demand(v)).select("weeks", "slope", "intercept", "r2")
)
query(
    "trend_t",
    "J111",
    f"select weeks, slope, r2, sign(slope) * sqrt(r2 * (weeks - 2) / greatest(1 - r2, 0)) as t from (select {_TREND}, regr_r2(value, pos) as r2 from {DEMAND} having count(value) >= 12)",
    "slope:5 r2:8 t:6",
)(lambda v: ts.trend_test(demand(v)).select("weeks", "slope", "r2", "t"))
query("trend_test", "J111 J125")(lambda v: ts.trend_test(demand(v)))
_PATTERN = f"(select cast({WEEK} % 52 as int) as cycle_week, avg(value) as value from {PRICE} where n >= 52 group by 1)"
query("seasonal_pattern", "J112 B20", f"select * from {_PATTERN}", "value:7")(lambda v: ts.seasonal_pattern(price(v), WEEK))
query(
    "seasonal_pattern_one_based",
    "J112",
    f"select cast(({WEEK} - 1) % 52 + 1 as int) as cycle_week, avg(value) as value from {PRICE} where n >= 52 group by 1",
    "value:7",
)(lambda v: ts.seasonal_pattern(price(v), WEEK, one_based=True))
query(
    "seasonal_extremes",
    "J112 D18",
    "select first(cycle_week order by value desc, cycle_week) as peak_week, max(value) as peak_value, "
    f"first(cycle_week order by value, cycle_week) as trough_week, min(value) as trough_value from {_PATTERN}",
    "peak_value,trough_value:7",
)(lambda v: ts.seasonal_extremes(ts.seasonal_pattern(price(v), WEEK)))
query(
    "seasonal_strength",
    "J113 D20",
    f"select var_samp(value) as pattern_var, var_samp(value) / (select var_samp(value) from {PRICE}) as strength from {_PATTERN}",
    "pattern_var:5 strength:8",
)(lambda v: ts.seasonal_strength(price(v), WEEK))
_INDEX = f"(select *, value / nullif(avg(value) over (), 0) as index from {PRICE})"
query("seasonal_index", "J114", f"select * from {_INDEX}", "value:7 index:9 pos:i")(lambda v: ts.seasonal_index(price(v)))
query(
    "seasonal_index_summary",
    "J114",
    f"select first({WEEK} order by index desc, {WEEK}) as highest_week, max(index) as highest_index, "
    f"first({WEEK} order by index, {WEEK}) as lowest_week, min(index) as lowest_index, stddev_samp(index) as index_std from {_INDEX}",
    "highest_index,lowest_index,index_std:8",
)(lambda v: ts.seasonal_index_summary(ts.seasonal_index(price(v)), WEEK))


def changes_sql(source, key=""):
    part = f"partition by {key} " if key else ""
    over = f"({part})"
    return (
        f"(select *, stddev_samp(change) over {over} * 2 as lim from (select *, (value - lag(value) over w) / nullif(lag(value) over w, 0) as change "
        f"from {source} window w as ({part}order by {WEEK})))"
    )


query("volatile_periods", "J115 E4", f"select {WEEK}, value, change from {changes_sql(PRICE)} where abs(change) > lim", "value,change:8")(
    lambda v: ts.volatile_periods(price(v), WEEK)
)
query(
    "volatile_periods_by_store",
    "J115",
    f"select store_nbr, {WEEK}, value, change from {changes_sql(BY_STORE, 'store_nbr')} where abs(change) > lim",
    "value,change:7",
)(lambda v: ts.volatile_periods(price_by_store(v), WEEK, ["store_nbr"]))
query(
    "volatile_summary",
    "J115",
    f"select count(*) as weeks, avg(change) as avg_change, first({WEEK} order by abs(change) desc, {WEEK}) as most_volatile_week, "
    f"max(abs(change)) as largest_change from {changes_sql(PRICE)} where abs(change) > lim",
    "avg_change,largest_change:8",
)(lambda v: ts.volatile_summary(ts.volatile_periods(price(v), WEEK), WEEK))
_CV = (
    "(select wm_week, case when avg(base_unit_retail_amt) <> 0 then stddev_samp(base_unit_retail_amt) / avg(base_unit_retail_amt) else 0 end as cv "
    "from instore group by 1)"
)
query("weekly_cv", "J116 I5", f"select * from {_CV}", "cv:8")(lambda v: ts.weekly_cv(v.instore, "wm_week", "base_unit_retail_amt"))
query("mean_weekly_cv", "J116", f"select avg(cv) as avg_cv from {_CV}", "avg_cv:8")(
    lambda v: ts.mean_weekly_cv(v.instore, "wm_week", "base_unit_retail_amt")
)
_ROLL = (
    "select {k}{w}, value, pos, n, case when count(value) over r = 4 then avg(value) over r end as rolling, "
    "regr_intercept(value, pos) over t + regr_slope(value, pos) over t * pos as trend_line from {s} "
    "window r as ({p} order by {w} rows between 3 preceding and current row), t as ({p})"
)
query("rolling_mean", "J117 E7", _ROLL.format(k="", w=WEEK, s=PRICE, p=""), "value,rolling,trend_line:7 pos:i")(
    lambda v: ts.rolling_mean(price(v), WEEK)
)
query(
    "rolling_mean_by_store",
    "J117",
    _ROLL.format(k="store_nbr, ", w=WEEK, s=BY_STORE, p="partition by store_nbr"),
    "value,rolling,trend_line:6 pos:i",
)(lambda v: ts.rolling_mean(price_by_store(v), WEEK, ["store_nbr"]))


def turns_sql(source, key="", above_mean=False):
    """Local extremes in order of height, taken one by one if far enough from those taken before."""
    lead = f"{key}, " if key else ""
    on = f"w.{key} = x.{key} and " if key else ""
    level = "and signed >= mean" if above_mean else ""
    return f"""
with recursive both_kinds as (
  select {lead}{WEEK}, pos, n, value, kind, if(kind = 'peak', value, -value) as signed from {source}, (select unnest(['peak', 'trough']) as kind)),
beside as (
  select *, lag(signed) over o as before, lead(signed) over o as after, avg(signed) over (partition by {lead}kind) as mean
  from both_kinds window o as (partition by {lead}kind order by pos)),
ranked as (
  select *, row_number() over (partition by {lead}kind order by signed desc, pos desc) as r from beside
  where n >= 12 and signed > before and signed > after {level}),
walk as (
  select distinct {lead}kind, 0::bigint as r, []::bigint[] as kept from ranked
  union all
  select {"w." + key + ", " if key else ""}w.kind, x.r, if(len(list_filter(kept, lambda k: abs(k - x.pos) < 4)) = 0, list_append(kept, x.pos), kept)
  from walk w join ranked x on {on}w.kind = x.kind and x.r = w.r + 1),
taken as (select {lead}kind, unnest(places) as pos from (select {lead}kind, arg_max(kept, r) as places from walk group by all))
select {lead}{WEEK}, pos, value, kind from taken join ranked using ({lead}kind, pos)"""


query("peaks_troughs", "J118", turns_sql(PRICE), "value:7 pos:i")(lambda v: ts.peaks_troughs(price(v), WEEK))
query("peaks_troughs_by_store", "J118", turns_sql(BY_STORE, "store_nbr", True), "value:7 pos:i")(
    lambda v: ts.peaks_troughs(price_by_store(v), WEEK, ["store_nbr"], above_mean=True)
)
query(
    "cycle_length",
    "J118",
    "select count(*) filter (kind = 'peak') as peaks, count(*) filter (kind = 'trough') as troughs, "
    "(max(pos) filter (kind = 'peak') - min(pos) filter (kind = 'peak')) / nullif(count(*) filter (kind = 'peak') - 1, 0) as avg_cycle "
    f"from ({turns_sql(PRICE)})",
    "avg_cycle:8",
)(lambda v: ts.cycle_length(ts.peaks_troughs(price(v), WEEK)))


def lag_sql(key=""):
    lead = f"{key}, " if key else ""
    part = f"partition by {key} " if key else ""
    return (
        f"select {lead}count(a) as own_changes, count(b) as rival_changes, {corr_sql('a', 'b')} as same_week, {corr_sql('b', 'pa')} as own_leads, "
        f"{corr_sql('a', 'pb')} as rival_leads from (select *, lag(a) over w as pa, lag(b) over w as pb from ("
        f"select {lead}wm_week, o - lag(o) over v as a, r - lag(r) over v as b from (select {lead}wm_week, avg(base_unit_retail_amt) as o, "
        f"avg(comp_reg) as r from instore group by all) window v as ({part}order by wm_week)) window w as ({part}order by wm_week)) "
        + (f"group by {key} " if key else "")
        + "having count(a) > 10 and count(b) > 10"
    )


LAG_ROUNDS = "same_week,own_leads,rival_leads:8"
query("lead_lag_corr", "J119 E5 E6", lag_sql(), LAG_ROUNDS)(
    lambda v: ts.lead_lag_corr(v.instore, "wm_week", "base_unit_retail_amt", "comp_reg")
)
query("lead_lag_corr_by_store", "J119", lag_sql("hg_store_id"), LAG_ROUNDS)(
    lambda v: ts.lead_lag_corr(v.instore, "wm_week", "base_unit_retail_amt", "comp_reg", ["hg_store_id"])
)
