"""Weekly price-gap dashboard: own prices and sales against the market, per region and item group.

Every stage is a function from DataFrames to a lazy DataFrame. :class:`PriceGapPlan` wires them; what
several stages read (weeks, calendar, own volume, modal prices, pivoted market) is kept in the
checkpoint folder once, so asking for a later stage runs jobs. Week codes are YYYYWW; sources that hold 1YYWW are
compared in their own code, which keeps the filter on the stored column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import WEEK_SHIFT, clean_upc, equalised, market_name_excluded, short_week_text
from ..functions.prefilter import with_known_keys
from ..session import kept_table, materialize, scalar_row
from ..sources.files import read_delimited, save_table

# Measures, market levels, period lengths and left-out markets of the market feed.
MEASURES = tuple(m + y for m in ("sales", "units", "promo_sales", "promo_units") for y in ("", "_ya"))
LEVELS = {"total_mkt": "%ALL CHANNELS%", "gdm": "%GB +DR +MM%", "HG_MART": "%HG_MART%"}
PERIODS = {"1w": "%1 w/e%", "4w": "%4 w/e%", "12w": "%12 w/e%", "52w": "%52 w/e%"}
LEFT_OUT_MARKETS = ("CALGARY", "TORONTO", "VANCOUVER", "CENSUS", "DISCOUNT", "MARITIMES")

# Display names of the final table, in order.
DISPLAY = {
    "week_text": "hg Week",
    "region": "Region",
    "sbu_desc": "SBU",
    "dept_desc": "Department",
    "dept_category_desc": "Category",
    "group_code": "Group Code",
    "group_desc": "Group Code Description",
    "brand_type": "Brand Type",
    "total_mkt_sales_1w": "Total Mkt Sales 1W",
    "total_mkt_units_1w": "Total Mkt Units 1W",
    "total_mkt_promo_sales_1w": "Total Mkt Promo Sales 1W",
    "total_mkt_promo_units_1w": "Total Mkt Promo Units 1W",
    "gdm_sales_1w": "GDM Sales 1W",
    "gdm_units_1w": "GDM Units 1W",
    "gdm_promo_sales_1w": "GDM Promo Sales 1W",
    "gdm_promo_units_1w": "GDM Promo Units 1W",
    "cat_sales": "Cat Sales",
    "HG_MART_sales_1w": "HG_MART Sales 1W",
    "HG_MART_units_1w": "HG_MART Units 1W",
    "HG_MART_promo_sales_1w": "HG_MART Promo Sales 1W",
    "HG_MART_promo_units_1w": "HG_MART Promo Units 1W",
    "total_mkt_units_52w": "Total Mkt Units 52W",
    "edlp_flag": "EDLP",
    "own_live": "hg Live",
    "own_reg": "hg Reg",
    "comp_live": "Comp Live",
    "comp_reg": "Comp Reg",
    "own_live_dlr": "hg Live Dol",
    "own_reg_dlr": "hg Reg Dol",
    "comp_live_dlr": "Comp Live Dol",
    "comp_reg_dlr": "Comp Reg Dol",
    "own_sales": "hg T Sales",
    "own_units": "hg T Units",
    "promo_units": "hg P Units",
    "promo_sales": "hg P Sales",
    "baseline_units": "hg_Baseline",
    "incremental_units": "hg_Incremental",
}

NATIONAL = "NATIONAL"
ITEM_KEYS = ("sbu_desc", "dept_desc", "dept_category_desc", "upc_nbr", "group_code", "group_desc", "brand_type")
GROUP_KEYS = tuple(k for k in ITEM_KEYS if k != "upc_nbr")
# rows of the feed that a task groups, sorts and joins in memory
FEED_ROWS = 250_000

# the market measures that later stages read
_READ_PARTS = [
    (level, m, "1w") for level in LEVELS for m in ("sales", "units", "promo_sales", "promo_units")
] + [("total_mkt", "units", "52w")]
MARKET_READ = tuple("_".join(parts) for parts in _READ_PARTS)
READ_MEASURES = tuple(m for m in MEASURES if m in {"sales", "sales_ya"} | {m for _, m, _ in _READ_PARTS})


# ---- calendar --------------------------------------------------------------

def fiscal_week_start(calendar: DataFrame, as_of: dt.date) -> DataFrame:
    """First day of the fiscal week that holds ``as_of``."""
    current = calendar.where(F.col("cal_dt").cast("date") == F.lit(as_of)).select("hg_yr_wk_nbr")
    inside = calendar.join(current, "hg_yr_wk_nbr", "left_semi")
    return inside.agg(F.min(F.col("cal_dt").cast("date")).alias("start"))


def display_calendar(calendar: DataFrame, as_of: dt.date, back: int = 365, ahead: int = 110) -> DataFrame:
    """Numbered weeks around the current fiscal week with their first and last day."""
    start = fiscal_week_start(calendar, as_of).scalar()
    day = F.col("cal_dt").cast("date")
    weeks = (
        calendar.where(day.between(F.date_sub(start, back), F.date_add(start, ahead)))
        .groupBy("hg_yr_wk_nbr")
        .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    )
    # at most (back + ahead) / 7 rows
    return weeks.withColumn("seq", F.row_number().over(Window.orderBy("hg_yr_wk_nbr")))


def week_window(weeks: DataFrame, length: int = 53) -> DataFrame:
    """First and last of the first ``length`` display weeks."""
    return weeks.where(F.col("seq").between(1, length)).agg(
        F.min("hg_yr_wk_nbr").alias("first_week"), F.max("hg_yr_wk_nbr").alias("last_week")
    )


def sales_weeks(sales: DataFrame, after: int, week: str = "wm_yr_wk_nbr") -> DataFrame:
    """Weeks with sales after a bound, newest first in ``seq``. Bounded by the calendar."""
    weeks = sales.where(F.col(week) > after).select(F.col(week).alias("week")).distinct()
    return weeks.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("week"))))


def nth_week(weeks: DataFrame, n: int) -> Column:
    """The ``n``-th newest week as a scalar subquery (NULL when there are fewer)."""
    return weeks.where(F.col("seq") == n).agg(F.max("week").alias("week")).scalar()


# ---- own sales -------------------------------------------------------------

def group_map(catalog: DataFrame) -> DataFrame:
    return catalog.select("item_nbr", "old_nbr", "hg_iv_id", "var_long_desc").distinct()


def item_sales(sales: DataFrame, catalog: DataFrame, stores: DataFrame, weeks: DataFrame, span: int = 200) -> DataFrame:
    """Sales and units per week, region, item and hierarchy over the last ``span`` week codes.

    Sales are folded to week x store x item before the region is joined, and to week x region x item
    before the hierarchy is, so neither a busy store nor a best-selling item is a hot key.
    """
    since = weeks.agg((F.max("week") - span).alias("since")).scalar()
    regions = stores.select("store_nbr", F.col("hg_region").alias("region")).distinct()
    sums = {"own_sales": "wkly_sales_amt", "own_units": "wkly_qty"}
    by_store = (
        sales.where(F.col("wm_yr_wk_nbr") >= since)
        .groupBy(F.col("wm_yr_wk_nbr").alias("week"), "store_nbr", "item_nbr", "upc_nbr")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    folded = _summed(by_store.join(regions, "store_nbr", "left"), ["week", "region", "item_nbr", "upc_nbr"], list(sums))
    hierarchy = catalog.select(
        "item_nbr",
        "sbu_nbr",
        "sbu_desc",
        "dept_nbr",
        "dept_desc",
        "dept_category_nbr",
        "dept_category_desc",
        "brand_type",
        F.col("hg_iv_id").alias("group_code"),
        F.col("var_long_desc").alias("group_desc"),
    ).distinct()
    joined = folded.join(hierarchy, "item_nbr").withColumn("brand_type", F.coalesce("brand_type", F.lit("NB")))
    numbers = ("sbu_nbr", "dept_nbr", "dept_category_nbr")
    return _summed(joined, ["week", "region", "item_nbr", *numbers, *ITEM_KEYS], ["own_sales", "own_units"])


def _summed(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def _with_national(df: DataFrame, region: str, keys: Sequence[str], measures: dict[str, Column], label: str = NATIONAL) -> DataFrame:
    """Aggregate per (region, keys) and, as ``label``, over all regions, in one grouping-sets pass.

    ``grouping`` tells the total from the group of rows whose region is missing.
    """
    out = df.groupingSets([[region, *keys], list(keys)], region, *keys).agg(
        F.grouping(region).alias("_total"), *[c.alias(n) for n, c in measures.items()]
    )
    named = F.when(F.col("_total") == 1, F.lit(label)).otherwise(F.col(region))
    return out.withColumn(region, named).drop("_total")


def item_volume(items: DataFrame) -> DataFrame:
    # one exchange for this and for the national total
    return _summed(items.repartition("week", "upc_nbr"), ["week", "region", *ITEM_KEYS], ["own_sales", "own_units"])


def item_volume_levels(volume: DataFrame) -> DataFrame:
    """Regional rows and the national total, which is taken over the regional sums."""
    regional = _summed(volume, ["week", "region", *ITEM_KEYS], ["own_sales", "own_units"])
    national = _summed(regional, ["week", *ITEM_KEYS], ["own_sales", "own_units"])
    return regional.unionByName(national.withColumn("region", F.lit(NATIONAL)))


# ---- prices ----------------------------------------------------------------

def own_prices(prices: DataFrame, groups: DataFrame, after: Column) -> DataFrame:
    """Distinct weekly store prices after a week, with the group code of the item."""
    kept = (
        prices.where(F.col("wm_wk_nbr") > after - WEEK_SHIFT)
        .select(
            (F.col("wm_wk_nbr") + WEEK_SHIFT).alias("week"),
            "item_nbr",
            "store_nbr",
            F.col("region_nm").alias("region"),
            F.col("live_price_amt").alias("own_live"),
            F.col("defined_reg_price_amt").alias("own_reg"),
        )
        .distinct()
    )
    codes = groups.select("item_nbr", F.col("hg_iv_id").alias("group_code")).distinct()
    return kept.join(codes, "item_nbr", "left")


def pair_counts(prices: DataFrame, values: Sequence[str]) -> DataFrame:
    """How often each price pair occurs per week, region and group."""
    return prices.groupBy("week", "region", "group_code", *values).agg(F.count(F.lit(1)).alias("n"))


def modal_pairs(counted: DataFrame, values: Sequence[str]) -> DataFrame:
    """Most frequent price pair per week and group, by region and nationally, from :func:`pair_counts`.

    Ties go to the smallest pair, NULL first. The national count adds the regional counts, and
    ``min`` over (-count, pair) needs no sort.
    """
    rest = ["week", "group_code", *values]
    both = counted.groupingSets([["region", *rest], rest], "region", *rest).agg(
        F.grouping("region").alias("_total"), F.sum("n").alias("n")
    )
    best = both.groupBy("week", "_total", "region", "group_code").agg(
        F.min(F.struct((-F.col("n")).alias("n"), *values)).alias("best")
    )
    named = F.when(F.col("_total") == 1, F.lit(NATIONAL)).otherwise(F.col("region"))
    return best.select("week", named.alias("region"), "group_code", *[F.col("best")[v].alias(v) for v in values])


def modal_prices(prices: DataFrame, values: Sequence[str]) -> DataFrame:
    return modal_pairs(pair_counts(prices, values), values)


def competitor_prices(feed: DataFrame, groups: DataFrame, after: Column, distinct: bool = True) -> DataFrame:
    """Equalised competitor prices after a week, with the group code of the old item number.

    ``distinct`` may be off where the consumer takes a minimum.
    """
    factor = F.col("equalization_factor")
    kept = feed.where(F.col("hg_week") > after - WEEK_SHIFT).select(
        (F.col("hg_week") + WEEK_SHIFT).alias("week"),
        F.col("hg_store_id").alias("store_nbr"),
        F.col("hg_region").alias("region"),
        "upc_nbr",
        "item_nbr",
        "banner_name",
        equalised(F.col("comp_reg"), factor).alias("comp_reg_eq"),
        equalised(F.col("comp_live"), factor).alias("comp_live_eq"),
    )
    kept = kept.distinct() if distinct else kept
    codes = groups.select(F.col("old_nbr").alias("item_nbr"), F.col("hg_iv_id").alias("group_code")).distinct()
    return kept.join(codes, "item_nbr", "left")


def market_low(competitor: DataFrame) -> DataFrame:
    """Lowest regular and live price per week, store and item; each falls back to the other."""
    regular, live = F.col("comp_reg_eq"), F.col("comp_live_eq")
    return (
        competitor.where((regular > 0.1) | (live > 0.1))
        .groupBy("week", "store_nbr", "region", "upc_nbr", "item_nbr", "group_code")
        .agg(F.min(F.coalesce(regular, live)).alias("comp_reg"), F.min(F.coalesce(live, regular)).alias("comp_live"))
        .withColumn("banner_name", F.lit("MKT_LOW"))
    )


# ---- market feed -----------------------------------------------------------

def latest_market_week(market: DataFrame) -> DataFrame:
    return market.agg(F.max("promo_yr_wk").alias("latest_week"))


def _market_kept(market: DataFrame) -> DataFrame:
    return market.where(
        ~market_name_excluded(F.col("market_description"), LEFT_OUT_MARKETS) & F.col("period_description").isNotNull()
    )


def market_parts(market: DataFrame) -> int:
    """Tasks of about :data:`FEED_ROWS` rows for the feed, which is counted: more rows would be sorted and grouped on disk."""
    return max(1, -(-_market_kept(market).count() // FEED_ROWS))


def _repartitioned(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def market_clean(market: DataFrame, for_map: bool = False, measures: Sequence[str] = MEASURES, parts: int | None = None) -> DataFrame:
    """Text measures summed as numbers per week, region, market, period and bare UPC.

    ``for_map`` places the rows by the UPC, as the UPC map is joined, so that the tall rows are sent once for
    both, and adds the ``_region`` of that join. ``parts``: see :func:`market_parts`.
    """
    # numbers are sent, not their texts
    bare = {"market_upc": clean_upc(F.col("upc")), **{m: F.col(m).try_cast("double") for m in measures}}
    # the exchange serves this aggregation, which barely reduces the rows, and those by fewer keys that follow
    keys = ["promo_yr_wk", "region", "market_description", "period_description", "market_upc"]
    rows = _market_kept(market).withColumns(bare).select(*keys, *measures)
    if for_map:
        return _summed(_upper_region(_repartitioned(rows, parts, "market_upc")), ["_region", *keys], measures)
    return _summed(_repartitioned(rows, parts, "promo_yr_wk", "region", "market_upc"), keys, measures)


def _with_map_region(df: DataFrame) -> DataFrame:
    return df if "_region" in df.columns else _upper_region(df)


def _with_map(clean: DataFrame, keys: DataFrame) -> DataFrame:
    """Left join of map rows by ``_region`` and UPC.

    Rows placed by UPC are joined by that alone, to one list of map rows for each UPC, of which those of
    the region are taken.
    """
    if "_region" not in clean.columns:
        return _upper_region(clean).join(keys, ["_region", "market_upc"], "left")
    known = keys.where(F.col("_region").isNotNull() & F.col("market_upc").isNotNull())
    names = [c for c in keys.columns if c not in ("_region", "market_upc")]
    lists = known.groupBy("market_upc").agg(F.collect_list(F.struct("_region", *names)).alias("_own"))
    of_region = F.filter("_own", lambda x: x["_region"] == F.col("_region"))
    joined = clean.join(lists, "market_upc", "left").withColumn("_own", F.explode_outer(of_region))
    rest = [c for c in clean.columns if c not in ("_region", "market_upc")]
    return joined.select("_region", "market_upc", *rest, *[F.col("_own")[c].alias(c) for c in names])


def _map_keys(clean: DataFrame, upc_map: DataFrame, parts: int | None) -> DataFrame:
    """The UPC map by upper-case region, placed as ``clean`` is if that was placed for it."""
    keys = upc_map.withColumn("_region", F.upper("region")).drop("region")
    return _repartitioned(keys, parts, "market_upc") if "_region" in clean.columns else keys


def market_mapped(clean: DataFrame, upc_map: DataFrame, parts: int | None = None) -> DataFrame:
    """Own UPCs of each market UPC; region compared without case. ``_region`` stays if it was given."""
    keys = _map_keys(clean, upc_map.select("region", "market_upc", "own_upc"), parts)
    joined = _with_map(clean, keys)
    return joined if "_region" in clean.columns else joined.drop("_region")


def market_duplicates(mapped: DataFrame) -> DataFrame:
    """Add the number of own UPCs that share a market UPC (0 for none).

    Counted for each spelling of the region and looked up without case, so rows of a region spelled in
    two cases come once for each. One window over the rows of a region and UPC, so the feed is read once.
    """
    pairs = F.collect_set(F.struct("region", "own_upc")).over(Window.partitionBy("_region", "market_upc"))
    spelt = F.array_distinct(F.transform("_pairs", lambda x: x["region"]))
    counts = F.transform(spelt, lambda r: F.size(F.filter("_pairs", lambda x: (x["region"] == r) & x["own_upc"].isNotNull())).cast("long"))
    alone = F.col("_region").isNull() | F.col("market_upc").isNull()
    out = _with_map_region(mapped).withColumn("_pairs", pairs)
    out = out.withColumn("own_upcs", F.explode(F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(counts)))
    return out.drop("_region", "_pairs")


def market_shared(clean: DataFrame, upc_map: DataFrame, parts: int | None = None, single: bool = False) -> DataFrame:
    """:func:`market_mapped` and :func:`market_duplicates` in one join.

    The number of own UPCs is a property of the map, so it is counted there and the feed is read
    once. (Counted over the feed, a region spelled in two cases would repeat its rows.) ``single`` adds
    ``_single``, whether the map has the own UPC for one market UPC only, in whatever regions.
    """
    upc_map = upc_map.select("region", "market_upc", "own_upc")
    if single:
        of_own = Window.partitionBy("own_upc")
        alone = F.col("own_upc").isNotNull() & (F.min("market_upc").over(of_own) == F.max("market_upc").over(of_own))
        upc_map = upc_map.withColumn("_single", alone)
    of_key = Window.partitionBy("_region", "market_upc")
    keys = _map_keys(clean, upc_map, parts).withColumn("own_upcs", F.size(F.collect_set("own_upc").over(of_key)).cast("long"))
    joined = _with_map(clean, keys)
    return joined.withColumn("own_upcs", F.coalesce("own_upcs", F.lit(0))).drop("_region")


def _by_own(shared: DataFrame, measures: Sequence[str], keys: Sequence[str], parts: int | None) -> tuple[DataFrame, list[str]]:
    """Rows with all of a week and own UPC in one task, and the column that tells so, if it is needed as a key.

    With ``_single`` only rows are sent whose own UPC has several market UPCs, or that have none: the others lie
    together as they are. ``_place`` is the same for all rows of a week and own UPC.
    """
    keys = ["promo_yr_wk", "region", *keys, "own_upc"]
    if "_single" not in shared.columns:
        return _repartitioned(shared.select(*keys, *measures), parts, "promo_yr_wk", "own_upc"), []
    single = F.coalesce("_single", F.lit(False))
    stay = shared.where(single).select(F.col("market_upc").alias("_place"), *keys, *measures)
    sent = shared.where(~single).select(F.concat_ws(" ", "promo_yr_wk", "own_upc").alias("_place"), *keys, *measures)
    return stay.unionByName(_repartitioned(sent, parts, "_place")), ["_place"]


def _both_levels(rows: DataFrame, place: Sequence[str], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Regional sums and the national ones, each in the task where its rows lie.

    Rows of an exchange are read twice, so that none is copied; rows with a ``place`` come from a join, which would run twice.
    """
    if place:
        region = F.explode(F.array(F.struct("region", F.lit(False).alias("total")), F.struct(F.lit(NATIONAL).alias("region"), F.lit(True).alias("total"))))
        both = rows.withColumn("_level", region).withColumns({"region": F.col("_level.region"), "_total": F.col("_level.total")})
        return _summed(both, [*place, "region", "_total", *keys], measures).drop("_total")
    regional = _summed(rows, ["region", *keys], measures)
    return regional.unionByName(_summed(regional, keys, measures).withColumn("region", F.lit(NATIONAL)))


def market_split(duplicated: DataFrame) -> DataFrame:
    """Share the measures among the own UPCs; keep rows with sales this year or last."""
    share = F.greatest(F.col("own_upcs"), F.lit(1))
    kept = duplicated.where((F.col("sales") > 0) | (F.col("sales_ya") > 0))
    return kept.withColumns({m: F.col(m) / share for m in MEASURES}).drop("own_upcs")


def market_levels(split: DataFrame, parts: int | None = None) -> DataFrame:
    """Regional rows and the national total, which is taken over the regional sums of the same exchange.

    That exchange, by week and own UPC, also serves the aggregations that follow. With ``_single`` from
    :func:`market_shared`, few rows are sent, and ``_place`` stays as a further key of those aggregations.
    """
    rows, place = _by_own(split, MEASURES, ["market_description", "period_description"], parts)
    return _both_levels(rows, place, ["promo_yr_wk", "market_description", "period_description", "own_upc"], MEASURES)


def _place(df: DataFrame) -> list[str]:
    return [c for c in ("_place",) if c in df.columns]


def market_by_level(levels: DataFrame) -> DataFrame:
    """One column per market level and measure."""
    name = F.col("market_description")
    return levels.groupBy(*_place(levels), "promo_yr_wk", "region", "period_description", "own_upc").agg(
        *[
            F.sum(F.when(name.like(pattern), F.col(m))).alias(f"{level}_{m}")
            for level, pattern in LEVELS.items()
            for m in MEASURES
        ]
    )


def market_by_period(by_level: DataFrame) -> DataFrame:
    """One column per market level, measure and period; unread columns are pruned downstream."""
    name = F.col("period_description")
    return by_level.groupBy(*_place(by_level), "promo_yr_wk", "region", "own_upc").agg(
        *[
            F.sum(F.when(name.like(pattern), F.col(f"{level}_{m}"))).alias(f"{level}_{m}_{period}")
            for period, pattern in PERIODS.items()
            for level in LEVELS
            for m in MEASURES
        ]
    )


def market_pivot(clean: DataFrame, upc_map: DataFrame, parts: int | None = None) -> DataFrame:
    """The market measures that later stages read, by region and nationally, per own UPC.

    Same figures as :func:`market_split`, :func:`market_levels`, :func:`market_by_level` and
    :func:`market_by_period` in turn. The share of an own UPC is one factor per (region, market
    UPC), so the tall rows are pivoted first and the map is joined to the folded ones; the national
    total is taken over the few rows at the end.
    """
    market, period = F.col("market_description"), F.col("period_description")
    kept = clean.where((F.col("sales") > 0) | (F.col("sales_ya") > 0))
    region = [c for c in ("_region",) if c in clean.columns]
    folded = kept.groupBy(*region, "promo_yr_wk", "region", "market_upc").agg(
        *[
            F.sum(F.when(market.like(LEVELS[level]) & period.like(PERIODS[length]), F.col(m))).alias(name)
            for name, (level, m, length) in zip(MARKET_READ, _READ_PARTS)
        ]
    )
    shared = market_shared(folded, upc_map, parts)
    share = F.greatest(F.col("own_upcs"), F.lit(1))
    rows, place = _by_own(shared.withColumns({m: F.col(m) / share for m in MARKET_READ}), MARKET_READ, [], parts)
    return _both_levels(rows, place, ["promo_yr_wk", "own_upc"], MARKET_READ).select("region", "promo_yr_wk", "own_upc", *MARKET_READ)


def market_rows_read(market: DataFrame) -> DataFrame:
    """Feed rows that reach a measure read later. The filter is on stored columns, so it reaches the scan.

    Exact before :func:`attach_market`: a key left without rows has NULL measures there either way.
    """
    name, period = F.col("market_description"), F.col("period_description")
    used = sorted({(level, length) for level, _, length in _READ_PARTS})
    return market.where(reduce(or_, [name.like(LEVELS[a]) & period.like(PERIODS[b]) for a, b in used]))


def market_measures_read(market: DataFrame) -> DataFrame:
    """The whole feed with :data:`READ_MEASURES` only, without figures that :func:`market_pivot` does not read.

    Sales stay in every row, since they tell whether it counts.
    """
    name, period = F.col("market_description"), F.col("period_description")

    def where_read(m: str) -> Column:
        used = sorted({(level, length) for level, x, length in _READ_PARTS if x == m})
        return F.when(reduce(or_, [name.like(LEVELS[a]) & period.like(PERIODS[b]) for a, b in used]), F.col(m))

    kept = [m for m in READ_MEASURES if m not in ("sales", "sales_ya")]
    return market.drop(*[m for m in MEASURES if m not in READ_MEASURES]).withColumns({m: where_read(m) for m in kept})


def market_of_own_items(market: DataFrame, upc_map: DataFrame, volume: DataFrame) -> DataFrame:
    """Feed rows whose UPC may belong to an item with own sales, told before the feed is shuffled.

    Exact before :func:`attach_market`, which looks up own items only: shares of a UPC come from the
    map, so they do not change. Weeks before the first or after the last one with own sales have no row
    to be attached to. The filter may let other rows pass.
    """
    span = scalar_row(volume.agg(F.min("week").alias("first"), F.max("week").alias("last")))
    market = market.where(F.col("promo_yr_wk").between(span["first"] - WEEK_SHIFT, span["last"] - WEEK_SHIFT))
    own = volume.select(F.col("upc_nbr").cast("bigint").alias("_own")).distinct()
    wanted = upc_map.select("market_upc", F.col("own_upc").try_cast("bigint").alias("_own")).join(own, "_own", "left_semi")
    return with_known_keys(market, clean_upc(F.col("upc")), wanted.select("market_upc"))


# ---- merge -----------------------------------------------------------------

def _upper_region(df: DataFrame) -> DataFrame:
    return df.withColumn("_region", F.upper("region"))


def attach_market(volume: DataFrame, market: DataFrame) -> DataFrame:
    """Own sales with the market measures of the same week, region and UPC."""
    right = market.select(
        (F.col("promo_yr_wk") + WEEK_SHIFT).alias("week"),
        F.upper("region").alias("_region"),
        F.col("own_upc").cast("bigint").alias("_upc"),
        *MARKET_READ,
    )
    left = _upper_region(volume.where(F.col("region").isNotNull())).withColumn("_upc", F.col("upc_nbr").cast("bigint"))
    return left.join(right, ["week", "_region", "_upc"], "left").select(
        "week", "region", *ITEM_KEYS, *MARKET_READ, F.col("own_sales").cast("double"), F.col("own_units").cast("double")
    )


def roll_up_upcs(attached: DataFrame, for_prices: bool = False) -> DataFrame:
    """Sums over the UPCs of a group. ``for_prices`` places the rows as prices are joined, by the ``_region`` it adds."""
    keys, sums = ["week", "region", *GROUP_KEYS], [*MARKET_READ, "own_sales", "own_units"]
    if for_prices:
        return _summed(_upper_region(attached).repartition("week", "_region", "group_code"), ["_region", *keys], sums)
    return _summed(attached, keys, sums)


def attach_prices(rolled: DataFrame, own: DataFrame, competitor: DataFrame) -> DataFrame:
    """Own and competitor modal prices of the week, region and group."""
    keys = ["week", "_region", "group_code"]
    own = own.select("week", F.upper("region").alias("_region"), "group_code", "own_live", "own_reg")
    competitor = competitor.select("week", F.upper("region").alias("_region"), "group_code", "comp_live", "comp_reg")
    # the left side is grouped and the price sides are made distinct, so the joined rows are distinct
    joined = _with_map_region(rolled).join(own.distinct(), keys, "left").join(competitor.distinct(), keys, "left")
    return joined.drop("_region")


def infer_competitor(priced: DataFrame) -> DataFrame:
    """Fill missing competitor prices by market-minus-own-banner sales over units, rounded to cents.

    From here on stages work row by row on distinct rows, so they need no further ``distinct``.
    """

    def implied(level, kind):
        value = F.col(f"{level}_{kind}sales_1w") - F.col(f"HG_MART_{kind}sales_1w")
        units = F.col(f"{level}_{kind}units_1w") - F.col(f"HG_MART_{kind}units_1w")
        return F.try_divide(value, units)

    def missing(c):
        return F.col(c).isNull() | (F.col(c) == 0)

    units = F.col("total_mkt_units_52w")
    return priced.withColumns(
        {
            "total_mkt_units_52w": F.when(units.isNull() | (units < 1), F.lit(1.0)).otherwise(units),
            "comp_live": F.round(
                F.when(missing("comp_live"), implied("gdm", "promo_")).otherwise(F.col("comp_live")), 2
            ),
            "comp_reg": F.round(
                F.when(missing("comp_reg"), implied("total_mkt", "")).otherwise(F.col("comp_reg")), 2
            ),
        }
    )


def repair_competitor(inferred: DataFrame) -> DataFrame:
    """Drop non-positive regular prices; a missing or negative live price falls back to regular."""
    regular, live = F.col("comp_reg"), F.col("comp_live")
    return inferred.withColumns(
        {
            "comp_live": F.when((live.isNull() | (live < 0)) & (regular > 0), regular).otherwise(live),
            "comp_reg": F.when(regular > 0, regular),
        }
    )


def dollar_weighted(repaired: DataFrame, fix_comp_live: bool = False) -> DataFrame:
    """Prices times 52-week market units.

    The published output keeps a competitor live price only where it was missing (then it is the
    regular price) and weights the live competitor by the regular price; that is the default.
    ``fix_comp_live`` keeps the live price and weights by it.
    """
    units = F.col("total_mkt_units_52w")
    live_pair = (F.col("comp_live") > 0) & (F.col("own_live") > 0)
    reg_pair = (F.col("comp_reg") > 0) & (F.col("own_reg") > 0)
    shown = F.coalesce("comp_live", "comp_reg") if fix_comp_live else F.when(F.col("comp_live").isNull(), F.col("comp_reg"))
    weighted = F.col("comp_live") if fix_comp_live else F.col("comp_reg")
    return repaired.withColumns(
        {
            "own_live_dlr": F.when(live_pair, units * F.col("own_live")),
            "own_reg_dlr": F.when(reg_pair, units * F.col("own_reg")),
            "comp_live_dlr": F.when(live_pair, units * weighted),
            "comp_reg_dlr": F.when(reg_pair, units * F.col("comp_reg")),
            "comp_live": shown,
        }
    )


def group_sales(metrics: DataFrame, weeks: DataFrame, newest: int = 1, oldest: int = 52) -> DataFrame:
    """Weekly group sales with promotion split, baseline and incremental units, and national rows."""
    code = F.col("promo_hg_yr_wk")
    low, high = nth_week(weeks, oldest), nth_week(weeks, newest)
    promoted = (F.col("on_flyer") == F.lit(True)) | (F.col("on_cpp") == F.lit(True)) | (F.col("price_mechanic") != "EDLP")
    kept = metrics.where(code.between(low - WEEK_SHIFT, high - WEEK_SHIFT)).select(
        (code + WEEK_SHIFT).alias("week"),
        "region",
        F.col("group_code_nbr").alias("group_code"),
        "total_units",
        "total_sales",
        "base_units",
        promoted.alias("promoted"),
    )
    sums = {
        "units": F.sum("total_units"),
        "sales": F.sum("total_sales"),
        "promo_units": F.sum(F.when(F.col("promoted"), F.col("total_units"))),
        "promo_sales": F.sum(F.when(F.col("promoted"), F.col("total_sales"))),
        "baseline_units": F.sum("base_units"),
        "incremental_units": F.sum(F.col("total_units") - F.col("base_units")),
    }
    regional = kept.groupBy("week", "region", "group_code").agg(*[c.alias(n) for n, c in sums.items()])
    # the total over the folded rows, so that no source row is expanded
    return _with_national(regional, "region", ["week", "group_code"], {n: F.sum(n) for n in sums}, label="national")


def attach_group_sales(weighted: DataFrame, groups: DataFrame) -> DataFrame:
    """Override own sales and units by the group metrics and add the promotion measures."""
    right = _upper_region(groups).drop("region")
    joined = _upper_region(weighted).join(right, ["week", "group_code", "_region"], "left")
    return joined.withColumns(
        {
            "own_sales": F.coalesce("sales", "own_sales"),
            "own_units": F.coalesce("units", "own_units"),
            "cat_sales": F.lit(""),
            "edlp": F.lit(""),
        }
    ).drop("_region", "sales", "units")


def actioned_list(spark: SparkSession, path: str) -> DataFrame:
    """(group_code, effective_date) of a CSV file with the published headers; bad fields are NULL."""
    raw = read_delimited(spark, path, "`Group Code` string, `Effective date` string")
    return raw.select(
        F.col("Group Code").try_cast("bigint").alias("group_code"), F.col("Effective date").try_cast("date").alias("effective_date")
    )


def actioned_view(
    merged: DataFrame, actioned: DataFrame, weeks: DataFrame, as_of: dt.date, strict_week: bool = False
) -> DataFrame:
    """Flag actioned groups, apply the date and week filters, and rename for display.

    The published filter reads "effective before today, or not actioned and inside the week
    window". ``strict_week`` applies the week window to both.
    """
    window = scalar_row(week_window(weeks))
    right = actioned.select(F.col("group_code").cast("string").alias("_code"), "effective_date")
    joined = merged.withColumn("_code", F.col("group_code").cast("string")).join(
        right.withColumn("_hit", F.lit(1)), "_code", "left"
    )
    effective = F.col("effective_date") < F.lit(as_of)
    inside = F.col("week").cast("bigint").between(window["first_week"], window["last_week"])
    plain = F.col("_hit").isNull()
    kept = joined.where((effective | plain) & inside if strict_week else effective | (plain & inside))
    shown = kept.withColumns(
        {"week_text": short_week_text(F.col("week")), "edlp_flag": F.coalesce("_hit", F.lit(0))}
    )
    return shown.select(*[F.col(c).alias(name) for c, name in DISPLAY.items()])


def display_range(view: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct rows of a range of display weeks (text order, so inside one century)."""
    return view.where(F.col("hg Week").between(first, last)).distinct()


def filter_list(shown: DataFrame) -> DataFrame:
    """Distinct filter values with the actioned flag as YES or NO, ordered."""
    keys = ["Region", "SBU", "Department", "Category", "Group Code", "Group Code Description", "Brand Type", "EDLP"]
    out = shown.select(*keys, F.when(F.col("EDLP") == 1, "YES").otherwise("NO").alias("EDLP_Actioned")).distinct()
    return out.orderBy(*keys[:4])


# ---- wiring ----------------------------------------------------------------

@dataclass(frozen=True)
class PriceGapInputs:
    calendar: DataFrame
    catalog: DataFrame
    sales: DataFrame
    stores: DataFrame
    prices: DataFrame
    competitor: DataFrame
    market: DataFrame
    upc_map: DataFrame
    group_metrics: DataFrame
    actioned: DataFrame


@dataclass
class PriceGapPlan:
    """The stages over one set of inputs, each built when first asked for."""

    inputs: PriceGapInputs
    as_of: dt.date
    after_week: int
    first_shown: str
    last_shown: str
    strict_week: bool = False
    fix_comp_live: bool = False
    history: int = field(default=52)

    # a few hundred rows each, read by many stages
    weeks = cached_property(lambda s: materialize(sales_weeks(s.inputs.sales, s.after_week)))
    calendar = cached_property(lambda s: materialize(display_calendar(s.inputs.calendar, s.as_of)))
    groups = cached_property(lambda s: group_map(s.inputs.catalog))
    items = cached_property(lambda s: item_sales(s.inputs.sales, s.inputs.catalog, s.inputs.stores, s.weeks))
    volume = cached_property(lambda s: item_volume(s.items))
    volume_levels = cached_property(lambda s: kept_table(item_volume_levels(s.volume)))
    own = cached_property(lambda s: own_prices(s.inputs.prices, s.groups, nth_week(s.weeks, s.history)))
    own_modal = cached_property(lambda s: materialize(modal_prices(s.own, ["own_reg", "own_live"])))
    competitor = cached_property(
        lambda s: competitor_prices(s.inputs.competitor, s.groups, nth_week(s.weeks, s.history), distinct=False)
    )
    low = cached_property(lambda s: market_low(s.competitor))
    competitor_modal = cached_property(lambda s: materialize(modal_prices(s.low, ["comp_reg", "comp_live"])))
    parts = cached_property(lambda s: market_parts(s.inputs.market))
    clean = cached_property(lambda s: market_clean(s.inputs.market, parts=s.parts))
    placed = cached_property(lambda s: market_clean(s.inputs.market, for_map=True, parts=s.parts))
    mapped = cached_property(lambda s: market_mapped(s.placed, s.inputs.upc_map, s.parts).drop("_region"))
    duplicated = cached_property(lambda s: market_duplicates(market_mapped(s.placed, s.inputs.upc_map, s.parts)))
    shared = cached_property(lambda s: market_shared(s.placed, s.inputs.upc_map, s.parts))
    split = cached_property(lambda s: market_split(s.shared))
    # with the place of their rows, which is a key of the stages that follow
    placed_levels = cached_property(
        lambda s: market_levels(market_split(market_shared(s.placed, s.inputs.upc_map, s.parts, single=True)), s.parts)
    )
    placed_by_level = cached_property(lambda s: market_by_level(s.placed_levels))
    levels = cached_property(lambda s: s.placed_levels.drop("_place"))
    by_level = cached_property(lambda s: s.placed_by_level.drop("_place"))
    by_period = cached_property(lambda s: market_by_period(s.placed_by_level).drop("_place"))
    pivoted = cached_property(lambda s: s._pivot(market_measures_read(s.inputs.market), s.parts))
    read_parts = cached_property(lambda s: market_parts(market_rows_read(s.inputs.market)))
    market_read = cached_property(lambda s: s._pivot(market_rows_read(s.inputs.market), s.read_parts))
    # the same for items with own sales only, which is all that is attached; kept, since the filters of the
    # join reach one of its two levels only, and the feed would be sent once for each
    market_own = cached_property(
        lambda s: kept_table(
            s._pivot(market_of_own_items(market_rows_read(s.inputs.market), s.inputs.upc_map, s.volume_levels), s.read_parts)
        )
    )
    attached = cached_property(lambda s: attach_market(s.volume_levels, s.market_own))
    rolled = cached_property(lambda s: roll_up_upcs(s.attached))
    priced = cached_property(lambda s: attach_prices(roll_up_upcs(s.attached, for_prices=True), s.own_modal, s.competitor_modal))
    inferred = cached_property(lambda s: infer_competitor(s.priced))
    repaired = cached_property(lambda s: repair_competitor(s.inferred))
    weighted = cached_property(lambda s: dollar_weighted(s.repaired, s.fix_comp_live))
    group_sales = cached_property(lambda s: group_sales(s.inputs.group_metrics, s.weeks))
    merged = cached_property(lambda s: attach_group_sales(s.weighted, s.group_sales))
    view = cached_property(
        lambda s: actioned_view(s.merged, s.inputs.actioned, s.calendar, s.as_of, s.strict_week)
    )
    shown = cached_property(lambda s: display_range(s.view, s.first_shown, s.last_shown))
    filters = cached_property(lambda s: filter_list(s.shown))

    def _pivot(self, market: DataFrame, parts: int) -> DataFrame:
        clean = market_clean(market, for_map=True, measures=READ_MEASURES, parts=parts)
        return market_pivot(clean, self.inputs.upc_map, parts)

    def publish(self, shown: str, filters: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Write the display table and the filter table, both from one run of the plan.

        The second table is made from the first as written. ``path``: folder for external tables.
        """

        def save(df: DataFrame, name: str) -> DataFrame:
            return save_table(df, name, path=f"{path}/{name}" if path else None)

        main = save(self.shown, shown)
        return main, save(filter_list(main), filters)
