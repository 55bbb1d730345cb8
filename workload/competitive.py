"""Competitor price-match queries."""

from aislemetrics.operators import competitive
from workload.quality import DESCRIBE_ROUNDS, describe_sql
from workload.registry import query


def corr_sql(x, y):
    both = f"({x} is not null and {y} is not null)"
    return (
        f"covar_pop({x}, {y}) / nullif((stddev_pop({x}) filter {both.replace('(', '(where ', 1)}) * "
        f"(stddev_pop({y}) filter {both.replace('(', '(where ', 1)}), 0)"
    )


OWN, RIVAL, GAP = "base_unit_retail_amt", "comp_reg", "reg_price_gap"

query("price_match_corr", "J90 D23", f"select {corr_sql(OWN, RIVAL)} as correlation from instore", "correlation:8")(
    lambda v: competitive.price_match_corr(v.instore)
)
query("gap_describe", "J91 D16", describe_sql([GAP], "instore"), DESCRIBE_ROUNDS)(lambda v: competitive.gap_describe(v.instore))


def _rate(column, value="Y"):
    return f"100e0 * count(*) filter ({column} = '{value}') / count(*)"


query(
    "win_rates",
    "J92 D7",
    f"select {_rate('item_win')} as win_rate_pct, {_rate('item_draw')} as draw_rate_pct, {_rate('item_loss')} as loss_rate_pct from instore",
    "win_rate_pct,draw_rate_pct,loss_rate_pct:7",
)(lambda v: competitive.win_rates(v.instore))
query(
    "win_loss_rates",
    "J92",
    f"select {_rate('item_win')} as win_rate_pct, {_rate('item_win', 'N')} as loss_rate_pct from instore",
    "win_rate_pct,loss_rate_pct:7",
)(lambda v: competitive.win_loss_rates(v.instore))
query(
    "by_banner",
    "J93",
    f"select banner_name, avg({RIVAL}) as avg_rival, count({RIVAL}) as records, stddev_samp({RIVAL}) as std_rival, avg({GAP}) as avg_gap from instore where banner_name is not null group by 1",
    "avg_rival,std_rival,avg_gap:7",
)(lambda v: competitive.by_banner(v.instore))
query(
    "by_region",
    "J94",
    f"select hg_region, avg({OWN}) as avg_price, count({OWN}) as records, stddev_samp({OWN}) as std_price, avg({GAP}) as avg_gap, "
    f"quantile_cont({OWN}, 0.5) as median_price from instore where hg_region is not null group by 1",
    "avg_price,std_price,avg_gap,median_price:7",
)(lambda v: competitive.by_region(v.instore))
query(
    "by_brand_type",
    "J94",
    f"select brand_type, avg({OWN}) as avg_price, count({OWN}) as records, avg({GAP}) as avg_gap from instore where brand_type is not null group by 1",
    "avg_price,avg_gap:7",
)(lambda v: competitive.by_brand_type(v.instore))
query(
    "weekly_match_trend",
    "J95",
    f"select wm_week, avg({OWN}) as avg_price, count({OWN}) as records, avg({RIVAL}) as avg_rival, avg({GAP}) as avg_gap from instore group by 1",
    "avg_price,avg_rival,avg_gap:7",
)(lambda v: competitive.weekly_trend(v.instore))
query(
    "region_brand",
    "J96 I4",
    f"select hg_region, brand_type, avg({OWN}) as avg_price, count({OWN}) as records, stddev_samp({OWN}) as std_price, avg({GAP}) as avg_gap, "
    "count(*) filter (item_win = 'Y') as wins, 1e0 * count(*) filter (item_win = 'Y') / count(*) as win_rate "
    "from instore where hg_region is not null and brand_type is not null group by 1, 2",
    "avg_price,std_price,avg_gap,win_rate:7",
)(lambda v: competitive.region_brand(v.instore))
query(
    "interaction_matrix",
    "J97 D10",
    f"select hg_region, brand_type, avg({GAP}) as avg_gap from instore where hg_region is not null and brand_type is not null group by all",
    "avg_gap:7",
)(lambda v: competitive.interaction_matrix(v.instore))
query(
    "panel_variance",
    "J98 D20",
    f"select var_samp(m) as between_var, avg(v) as within_var, var_samp(m) / nullif(avg(v), 0) as ratio from "
    f"(select hg_store_id, avg({OWN}) as m, var_samp({OWN}) as v from instore group by 1)",
    "between_var,within_var:4 ratio:8",
)(lambda v: competitive.panel_variance(v.instore))
query(
    "variance_decomposition",
    "J99 D20",
    f"select \"grouping\", var_samp(m) as between_var, var_samp(m) / (select var_samp({OWN}) from instore) as share from ("
    + " union all ".join(
        f"select '{g}' as \"grouping\", avg({OWN}) as m from instore where {g} is not null group by {g}"
        for g in ("hg_region", "brand_type", "banner_name")
    )
    + ") group by 1",
    "between_var:4 share:8",
)(lambda v: competitive.variance_decomposition(v.instore))
query(
    "regional_match_trend",
    "J100",
    f"select hg_region, wm_week, avg({OWN}) as avg_price, (select avg({OWN}) from instore) as overall_avg from instore where hg_region is not null group by 1, 2",
    "avg_price,overall_avg:7",
)(lambda v: competitive.regional_trend(v.instore))
query(
    "competitive_report",
    "J101 D17",
    f"select count(*) as records, avg({OWN}) as avg_price, max({OWN}) - min({OWN}) as price_range, avg({GAP}) as avg_gap, "
    f"100e0 * count(*) filter ({GAP} > 0) / count({GAP}) as higher_priced_pct, {_rate('item_win')} as win_rate_pct, "
    "count(distinct hg_region) as regions, count(distinct wm_week) as weeks, min(wm_week) as first_week, max(wm_week) as last_week, "
    "(select hg_region from instore where hg_region is not null group by 1 order by count(*) desc, 1 limit 1) as top_region from instore",
    "avg_price,price_range,avg_gap,higher_priced_pct,win_rate_pct:6",
)(lambda v: competitive.competitive_report(v.instore))


def _response(keys=""):
    lead = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    join = f"and a.{keys} = b.{keys}" if keys else ""
    cols = f"a.{keys}, " if keys else ""
    return (
        f"with s as (select {lead}wm_week, avg({OWN}) as o, avg({RIVAL}) as r from instore group by all), "
        "c as (select *, o / nullif(lag(o) over w, 0) - 1 as own_change, r / nullif(lag(r) over w, 0) - 1 as rival_change from s "
        f"window w as ({part} order by wm_week)), t as (select *, stddev_samp(own_change) over ({part}) as lim from c) "
        f"select {cols}a.wm_week, a.own_change, b.rival_change as response, coalesce(a.own_change * b.rival_change > 0, false) as same_direction "
        f"from t a join c b on b.wm_week = a.wm_week + 1 {join} where abs(a.own_change) > a.lim"
    )


query("response_timing", "J102 C14 E4", _response(), "own_change,response:8")(lambda v: competitive.response_timing(v.instore))
query("response_timing_by_region", "J102", _response("hg_region"), "own_change,response:8")(
    lambda v: competitive.response_timing(v.instore, by=["hg_region"])
)
query(
    "response_summary",
    "J102",
    f"select count(*) as responses, 100e0 * count(*) filter (same_direction) / count(*) as same_direction_pct from ({_response()})",
    "same_direction_pct:7",
)(lambda v: competitive.response_summary(competitive.response_timing(v.instore)))
