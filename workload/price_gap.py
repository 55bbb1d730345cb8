"""Price-gap dashboard queries: one per stage, each against the same stages in SQL."""

import dataclasses
import datetime as dt
import re
import uuid

from pyspark.sql import functions as F

from aislemetrics.plans import price_gap as pg
from aislemetrics.plans import publishing
from aislemetrics.session import scratch_path
from workload.registry import query

AS_OF = dt.date(2001, 6, 15)
AFTER_WEEK = 199452
SHOWN = ("10001", "10144")


def hundreds(column):
    """Prices to the nearest hundred, so that price pairs repeat and the modal pair means something."""
    return F.round(F.col(column) / 100) * 100


def inputs(v):
    return pg.PriceGapInputs(
        calendar=v.calendar_dim,
        catalog=v.catalog,
        sales=v.weekly_sales,
        stores=v.store_dim,
        prices=v.store_price.withColumns(
            {c: hundreds(c) for c in ("live_price_amt", "defined_reg_price_amt")}
        ),
        competitor=v.instore.withColumns(
            {
                "hg_week": F.col("wm_week") - 190000,
                **{c: hundreds(c) for c in ("comp_reg", "comp_live")},
            }
        ),
        market=v.market_source,
        upc_map=v.upc_map,
        group_metrics=v.group_metrics,
        actioned=v.edlp_actioned,
    )


def plan(v, **options):
    return pg.PriceGapPlan(inputs(v), AS_OF, AFTER_WEEK, *SHOWN, **options)


# ---- the stages in SQL -----------------------------------------------------
# Written from what a stage means, with DuckDB's own means: grouping sets for the national level,
# ``arg_min`` for the modal pair, filtered sums for the pivots, counts taken from the UPC map.

K = ", ".join(pg.ITEM_KEYS)
G = ", ".join(pg.GROUP_KEYS)
MKT = ", ".join(pg.MARKET_READ)


def each(names, text="sum({0}) as {0}", **more):
    return ", ".join(text.format(n, **more) for n in names)


def both_levels(source, keys, measures, label="NATIONAL", **clauses):
    """Rows of every region and, as ``label``, of all regions together."""
    return (
        f"select if(grouping(region) = 1, '{label}', region) as region, {keys}, {measures} from {source} "
        f"{clauses.get('where', '')} group by grouping sets ((region, {keys}), ({keys}))"
    )


def most_frequent(source, first, second):
    """The commonest pair of a week and group; of equally common ones the smallest, missing values first."""
    return (
        f"with levels as (select grouping(region) as whole, region, week, group_code, {first}, {second}, count(*) as n from {source} "
        f"group by grouping sets ((region, week, group_code, {first}, {second}), (week, group_code, {first}, {second}))), "
        f"best as (select whole, region, week, group_code, arg_min({{'f': {first}, 's': {second}}}, "
        f"(-n, {first} is not null, coalesce({first}, 0), {second} is not null, coalesce({second}, 0))) as pair from levels group by all) "
        f"select week, if(whole = 1, 'NATIONAL', region) as region, group_code, pair.f as {first}, pair.s as {second} from best"
    )


def shelf(column):
    return f"100 * round({column} / 100)"


def implied(level, kind):
    """Price that the other shops of a level must have had: their sales over their units."""
    rest = "{0}_{1}{2}_1w - HG_MART_{1}{2}_1w"
    return f"({rest.format(level, kind, 'sales')}) / nullif({rest.format(level, kind, 'units')}, 0)"


def in_dollars(live_weight):
    pairs = {
        "own_live_dlr": ("live", "own_live"),
        "own_reg_dlr": ("reg", "own_reg"),
        "comp_live_dlr": ("live", live_weight),
        "comp_reg_dlr": ("reg", "comp_reg"),
    }
    return ", ".join(
        f"if(least(comp_{kind}, own_{kind}) > 0 and comp_{kind} is not null and own_{kind} is not null, total_mkt_units_52w * {price}, null) as {name}"
        for name, (kind, price) in pairs.items()
    )


PROMO_ROW = "(coalesce(on_flyer, false) or coalesce(on_cpp, false) or coalesce(price_mechanic <> 'EDLP', false))"

STAGES = {
    "p_start": f"from calendar_dim c semi join (from calendar_dim where cal_dt = date '{AS_OF}') t using (hg_yr_wk_nbr) select min(c.cal_dt) as start",
    "p_calendar": "with weeks as (select hg_yr_wk_nbr, min(cal_dt) as first_day, max(cal_dt) as last_day from calendar_dim, p_start "
    "where date_diff('day', start, cal_dt) between -365 and 110 group by hg_yr_wk_nbr) "
    "select weeks.*, (select count(*) from weeks w where w.hg_yr_wk_nbr <= weeks.hg_yr_wk_nbr) as seq from weeks",
    "p_window": "select min(hg_yr_wk_nbr) filter (seq < 54) as first_week, max(hg_yr_wk_nbr) filter (seq < 54) as last_week from p_calendar",
    "p_groups": "from catalog select item_nbr, old_nbr, hg_iv_id, var_long_desc group by all",
    "p_weeks": f"select distinct wm_yr_wk_nbr as week, dense_rank() over (order by wm_yr_wk_nbr desc) as seq from weekly_sales where wm_yr_wk_nbr > {AFTER_WEEK}",
    "p_bounds": "select max(week) as newest, max(week) - 200 as since, max(week) filter (seq = 52) as oldest from p_weeks",
    "p_items": "with sold as (select wm_yr_wk_nbr as week, hg_region as region, item_nbr, upc_nbr, sum(wkly_sales_amt) as s, sum(wkly_qty) as q "
    "from p_bounds, weekly_sales left join store_dim using (store_nbr) where wm_yr_wk_nbr >= since group by all), "
    "tree as (from catalog select item_nbr, sbu_nbr, sbu_desc, dept_nbr, dept_desc, dept_category_nbr, dept_category_desc, "
    "hg_iv_id as group_code, var_long_desc as group_desc, coalesce(brand_type, 'NB') as brand_type group by all) "
    f"select week, region, item_nbr, sbu_nbr, dept_nbr, dept_category_nbr, {K}, sum(s) as own_sales, sum(q) as own_units from tree join sold using (item_nbr) group by all",
    "p_volume": f"from p_items select week, region, {K}, {each(['own_sales', 'own_units'])} group by all",
    "p_volume_levels": both_levels("p_volume", f"week, {K}", each(["own_sales", "own_units"])),
    "p_own": "with code as (from p_groups select item_nbr, hg_iv_id as group_code group by all) "
    f"select 190000 + wm_wk_nbr as week, item_nbr, store_nbr, region_nm as region, {shelf('live_price_amt')} as own_live, "
    f"{shelf('defined_reg_price_amt')} as own_reg, group_code from p_bounds, store_price left join code using (item_nbr) "
    "where 190000 + wm_wk_nbr > oldest group by all",
    "p_own_modal": most_frequent("p_own", "own_reg", "own_live"),
    "p_comp": "with code as (from p_groups select old_nbr as item_nbr, hg_iv_id as group_code group by all), "
    "scaled as (select *, if(equalization_factor > 0, equalization_factor, 1) as factor from instore) "
    "select wm_week as week, hg_store_id as store_nbr, hg_region as region, upc_nbr, item_nbr, banner_name, "
    f"factor * {shelf('comp_reg')} as comp_reg_eq, factor * {shelf('comp_live')} as comp_live_eq, group_code "
    "from p_bounds, scaled left join code using (item_nbr) where wm_week > oldest group by all",
    "p_low": "from p_comp select week, store_nbr, region, upc_nbr, item_nbr, group_code, any_value('MKT_LOW') as banner_name, "
    "min(coalesce(comp_reg_eq, comp_live_eq)) as comp_reg, min(coalesce(comp_live_eq, comp_reg_eq)) as comp_live "
    "where greatest(comp_reg_eq, comp_live_eq) > 0.1 group by week, store_nbr, region, upc_nbr, item_nbr, group_code",
    "p_comp_modal": most_frequent("p_low", "comp_reg", "comp_live"),
    "p_clean": "from market_source select promo_yr_wk, region, market_description, period_description, "
    "regexp_replace(ltrim(upc, '0'), 'BP[0-9]', '', 'g') as market_upc, "
    + each(pg.MEASURES, "sum(try_cast({0} as double)) as {0}")
    + f" where not regexp_matches(market_description, '{'|'.join(pg.LEFT_OUT_MARKETS)}') and period_description is not null group by all",
    "p_key": "select upper(region) as area, market_upc, own_upc, count(distinct own_upc) over (partition by upper(region), market_upc) as shared from upc_map",
    "p_dup": "select f.*, own_upc, coalesce(shared, 0) as own_upcs from p_clean f left join p_key k on k.area = upper(f.region) and k.market_upc = f.market_upc",
    "p_mapped": "select * exclude (own_upcs) from p_dup",
    "p_split": "from p_dup select * exclude (own_upcs) replace ("
    + each(pg.MEASURES, "{0} / greatest(own_upcs, 1) as {0}")
    + ") where greatest(sales, sales_ya) > 0",
    "p_levels": both_levels("p_split", "promo_yr_wk, market_description, period_description, own_upc", each(pg.MEASURES)),
    "p_by_level": "from p_levels select promo_yr_wk, region, period_description, own_upc, "
    + ", ".join(each(pg.MEASURES, "sum({0}) filter (market_description like '{like}') as {level}_{0}", like=p, level=a) for a, p in pg.LEVELS.items())
    + " group by all",
    "p_by_period": "from p_levels select promo_yr_wk, region, own_upc, "
    + ", ".join(
        each(pg.MEASURES, "sum({0}) filter (market_description like '{like}' and period_description like '{span}') as {level}_{0}_{name}", like=p, level=a, span=q, name=b)
        for b, q in pg.PERIODS.items()
        for a, p in pg.LEVELS.items()
    )
    + " group by all",
    "p_attached": f"with feed as (select 190000 + promo_yr_wk as week, upper(region) as area, own_upc::bigint as code, {MKT} from p_by_period) "
    f"select v.week, region, {K}, {MKT}, own_sales::double as own_sales, own_units::double as own_units from p_volume_levels v "
    "left join feed on (feed.week, area, code) = (v.week, upper(region), upc_nbr::bigint) where region is not null",
    "p_rolled": f"from p_attached select week, region, {G}, {each([*pg.MARKET_READ, 'own_sales', 'own_units'])} group by all",
    "p_priced": "with o as (select * exclude (region), upper(region) as area from p_own_modal), c as (select * exclude (region), upper(region) as area from p_comp_modal) "
    "select distinct r.*, own_live, own_reg, comp_live, comp_reg from p_rolled r left join o on (o.week, o.area, o.group_code) = (r.week, upper(r.region), r.group_code) "
    "left join c on (c.week, c.area, c.group_code) = (r.week, upper(r.region), r.group_code)",
    "p_inferred": "from p_priced select * replace (greatest(coalesce(total_mkt_units_52w, 1), 1) as total_mkt_units_52w, "
    + ", ".join(
        # as a decimal, so that half a cent rounds up whatever its binary form
        f"round(coalesce(nullif({c}, 0), {other})::decimal(30, 9), 2)::double as {c}"
        for c, other in (("comp_live", implied("gdm", "promo_")), ("comp_reg", implied("total_mkt", "")))
    )
    + ")",
    "p_repaired": "from p_inferred select * replace (if(comp_reg > 0 and coalesce(comp_live, -1) < 0, comp_reg, comp_live) as comp_live, "
    "if(comp_reg > 0, comp_reg, null) as comp_reg)",
    "p_weighted": f"from p_repaired select * replace (if(comp_live is null, comp_reg, null) as comp_live), {in_dollars('comp_reg')}",
    "p_weighted_fixed": f"from p_repaired select * replace (coalesce(comp_live, comp_reg) as comp_live), {in_dollars('comp_live')}",
    "p_group_sales": both_levels(
        "group_metrics, p_bounds",
        "week, group_code",
        f"sum(total_units) as units, sum(total_sales) as sales, sum(total_units) filter {PROMO_ROW} as promo_units, sum(total_sales) filter {PROMO_ROW} as promo_sales, "
        "sum(base_units) as baseline_units, sum(total_units) - sum(base_units) as incremental_units",
        label="national",
    ),
    "p_merged": "select w.* replace (coalesce(g.sales, w.own_sales) as own_sales, coalesce(g.units, w.own_units) as own_units), "
    "'' as cat_sales, '' as edlp, promo_units, promo_sales, baseline_units, incremental_units from p_weighted w "
    "left join p_group_sales g on (g.week, g.group_code, upper(g.region)) = (w.week, w.group_code, upper(w.region))",
    "p_dated": "select m.*, (a.group_code is not null)::int as edlp_flag, '1' || lpad((week % 10000)::varchar, 4, '0') as week_text, "
    f"coalesce(effective_date < date '{AS_OF}', false) as in_force, week between first_week and last_week as inside "
    "from p_window, p_merged m left join edlp_actioned a on a.group_code = m.group_code",
    "p_view": "from p_dated select {columns} where in_force or (edlp_flag = 0 and inside)",
    "p_view_strict": "from p_dated select {columns} where inside and (in_force or edlp_flag = 0)",
    "p_shown": f"from p_view select distinct * where \"hg Week\" >= '{SHOWN[0]}' and \"hg Week\" <= '{SHOWN[1]}'",
    "p_filters": 'from p_shown select "Region", "SBU", "Department", "Category", "Group Code", "Group Code Description", "Brand Type", "EDLP", '
    "if(\"EDLP\" = 1, 'YES', 'NO') as \"EDLP_Actioned\" group by all",
}
for _name in ("p_view", "p_view_strict"):
    STAGES[_name] = STAGES[_name].format(columns=", ".join(f'{c} as "{n}"' for c, n in pg.DISPLAY.items()))
STAGES["p_group_sales"] = STAGES["p_group_sales"].replace(
    "from group_metrics, p_bounds",
    "from (select *, 190000 + promo_hg_yr_wk as week, group_code_nbr as group_code from group_metrics, p_bounds where 190000 + promo_hg_yr_wk between oldest and newest)",
)


def stage_sql(name):
    needed, todo = set(), [name]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [s for s in STAGES if re.search(rf"\b{s}\b", STAGES[n])]
    ctes = ", ".join(f"{s} AS MATERIALIZED ({STAGES[s]})" for s in STAGES if s in needed)
    return f"WITH {ctes} SELECT * FROM {name}"


def rounds(names, digits):
    return f"{','.join(n.replace(' ', '~') for n in names)}:{digits}"


OWN = "own_sales,own_units:2"
MARKET = rounds(pg.MEASURES, 4)
READ = rounds(pg.MARKET_READ, 4)
PRICES = "own_live,own_reg,comp_live,comp_reg:2"
DOLLARS = "own_live_dlr,own_reg_dlr,comp_live_dlr,comp_reg_dlr:3"
PROMO = "promo_units,promo_sales,baseline_units,incremental_units:2"
SHOWN_ROUNDS = rounds(
    [n for c, n in pg.DISPLAY.items() if c.endswith(("_1w", "_52w", "_dlr"))], 3
) + " " + rounds(
    [n for c, n in pg.DISPLAY.items() if c.startswith(("own_", "comp_", "promo_", "baseline", "incremental")) and not c.endswith("_dlr")], 2
)


def stage(name, covers, sql_stage, build, round_spec=""):
    query(f"gap_{name}", covers, stage_sql(sql_stage), round_spec)(build)


stage("week_start", "K1 C11 B31", "p_start", lambda v: pg.fiscal_week_start(v.calendar_dim, AS_OF))
stage("calendar", "K2 D1 E1", "p_calendar", lambda v: plan(v).calendar)
stage("week_window", "K3 D24", "p_window", lambda v: pg.week_window(plan(v).calendar))
stage("group_map", "K4 D13", "p_groups", lambda v: plan(v).groups)
stage("sales_weeks", "K5 D13 E1", "p_weeks", lambda v: plan(v).weeks)
stage("item_sales", "K6 C1 C2 C3 B24", "p_items", lambda v: plan(v).items, OWN)
stage("item_volume", "K7", "p_volume", lambda v: plan(v).volume, OWN)
stage("item_volume_levels", "K8 D12 G1", "p_volume_levels", lambda v: plan(v).volume_levels, OWN)
stage("own_prices", "K9 C3 B22 B31", "p_own", lambda v: plan(v).own, "own_live,own_reg:2")
stage("own_modal_prices", "K10 E2 G2", "p_own_modal", lambda v: plan(v).own_modal, "own_live,own_reg:2")
stage(
    "competitor_prices",
    "K11 B23 C4",
    "p_comp",
    lambda v: pg.competitor_prices(inputs(v).competitor, plan(v).groups, pg.nth_week(plan(v).weeks, 52)),
    "comp_reg_eq,comp_live_eq:2",
)
stage("market_low", "K12 B28", "p_low", lambda v: plan(v).low, "comp_reg,comp_live:2")
stage("competitor_modal_prices", "K13 E2", "p_comp_modal", lambda v: plan(v).competitor_modal, "comp_reg,comp_live:2")
query("gap_latest_market_week", "K14", "select max(promo_yr_wk) as latest_week from market_source")(
    lambda v: pg.latest_market_week(v.market_source)
)
stage("market_clean", "K15 B1 B21 B30 D14", "p_clean", lambda v: plan(v).clean, MARKET)
stage("market_mapped", "K16 C5", "p_mapped", lambda v: plan(v).mapped, MARKET)
stage("market_duplicates", "K17 C10", "p_dup", lambda v: plan(v).duplicated, MARKET)
stage("market_split", "K18 B26", "p_split", lambda v: plan(v).split, MARKET)
stage("market_levels", "K19 D12", "p_levels", lambda v: plan(v).levels, MARKET)
stage("market_by_level", "K20 D8", "p_by_level", lambda v: plan(v).by_level, rounds([f"{a}_{m}" for a in pg.LEVELS for m in pg.MEASURES], 4))
stage(
    "market_by_period",
    "K21 D9",
    "p_by_period",
    lambda v: plan(v).by_period,
    rounds([f"{a}_{m}_{p}" for p in pg.PERIODS for a in pg.LEVELS for m in pg.MEASURES], 4),
)
query(
    "gap_market_pivot",
    "K19 K20 K21 D8 D9",
    f"select promo_yr_wk, region, own_upc, {MKT} from ({stage_sql('p_by_period')})",
    READ,
)(lambda v: plan(v).pivoted)
query(
    "gap_market_read",
    "K19 K20 K21 D8 D9",
    f"select promo_yr_wk, region, own_upc, {MKT} from ({stage_sql('p_by_period')}) where coalesce({MKT}) is not null",
    READ,
)(lambda v: plan(v).market_read)
query("gap_market_shared", "K16 K17", stage_sql("p_dup"), MARKET)(lambda v: plan(v).shared)
stage("attach_market", "K22 C6 B2", "p_attached", lambda v: plan(v).attached, f"{READ} {OWN}")
stage("roll_up_upcs", "K23", "p_rolled", lambda v: plan(v).rolled, f"{READ} {OWN}")
stage("attach_prices", "K24 C7 D13", "p_priced", lambda v: plan(v).priced, f"{READ} {OWN} {PRICES}")
stage("infer_competitor", "K25 B24 B25", "p_inferred", lambda v: plan(v).inferred, f"{READ} {OWN} {PRICES}")
stage("repair_competitor", "K26", "p_repaired", lambda v: plan(v).repaired, f"{READ} {OWN} {PRICES}")
stage("dollar_weighted", "K27", "p_weighted", lambda v: plan(v).weighted, f"{READ} {OWN} {PRICES} {DOLLARS}")
stage(
    "dollar_weighted_fixed",
    "K27",
    "p_weighted_fixed",
    lambda v: plan(v, fix_comp_live=True).weighted,
    f"{READ} {OWN} {PRICES} {DOLLARS}",
)
stage("group_sales", "K28 D6 D12 B31", "p_group_sales", lambda v: plan(v).group_sales, f"units,sales:2 {PROMO}")
stage("attach_group_sales", "K29 C8 B28", "p_merged", lambda v: plan(v).merged, f"{READ} {OWN} {PRICES} {DOLLARS} {PROMO}")
stage("actioned_view", "K31 C9 B22 B27 B29", "p_view", lambda v: plan(v).view, SHOWN_ROUNDS)


def from_csv(v):
    """The view over an actioned list that was written as CSV and loaded with its published headers."""
    path = scratch_path(v.spark, "actioned")
    listed = v.edlp_actioned.select(F.col("group_code").alias("Group Code"), F.col("effective_date").alias("Effective date"))
    listed.write.option("header", True).csv(path)
    own = dataclasses.replace(inputs(v), actioned=pg.actioned_list(v.spark, path))
    return pg.PriceGapPlan(own, AS_OF, AFTER_WEEK, *SHOWN).view


def published(v):
    """The display table as the publishing step leaves it in the catalog."""
    mark = uuid.uuid4().hex
    path = scratch_path(v.spark, "published")
    return plan(v).publish(f"gap_shown_{mark}", f"gap_filters_{mark}", path)[0]


def published_weekly(v):
    """All weeks but the newest two in one go, then each of these by itself."""
    tables = publishing.WeeklyTables(scratch_path(v.spark, "weekly"), AS_OF, AFTER_WEEK)
    data = inputs(v)
    weeks = sorted(r.week for r in pg.sales_weeks(data.sales, AFTER_WEEK).select("week").collect())
    for part in (weeks[:-2], weeks[-2:-1], weeks[-1:]):
        tables.publish(data, part)
    return tables.shown(data, *SHOWN)


stage("published_weekly", "K10 K13 K32 K33 A6", "p_shown", published_weekly, SHOWN_ROUNDS)
stage("actioned_view_csv", "K30 K31", "p_view", from_csv, SHOWN_ROUNDS)
stage("published", "K32 K33 A6", "p_shown", published, SHOWN_ROUNDS)
stage("actioned_view_strict", "K31", "p_view_strict", lambda v: plan(v, strict_week=True).view, SHOWN_ROUNDS)
stage("display_range", "K32", "p_shown", lambda v: plan(v).shown, SHOWN_ROUNDS)
stage("filter_list", "K33 D13 F1", "p_filters", lambda v: plan(v).filters)
