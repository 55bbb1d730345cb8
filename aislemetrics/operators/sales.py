"""Weekly sales and inventory analysis. Inputs are frames from ``prepare.with_sales_metrics``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import describe, key_of_max, key_of_min, numbers_by, variation
from ..functions.columns import bins, has_keys, rate, ratio
from ..functions.running import cumulative_share, quantile_row
from ..session import materialize, scalar_row
from .series import both_ends, in_order, top_rows, total, weekly, whole


@dataclass(frozen=True)
class SalesColumns:
    store: str = "store_nbr"
    item: str = "item_nbr"
    week: str = "wm_yr_wk_nbr"
    sales: str = "wkly_sales_amt"
    qty: str = "wkly_qty"
    onhand: str = "onhand_invt_qty"
    transit: str = "in_trnst_invt_qty"
    ratio: str = "sales_to_inventory_ratio"


C = SalesColumns()


# ---- overviews -------------------------------------------------------------

def business_overview(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Stores, items, weeks, revenue and mean weekly revenue, as one row."""
    weeks = scalar_row(
        weekly(df, c.week, c.sales).agg(
            F.count(F.lit(1)).alias("weeks"),
            F.min(c.week).alias("first_week"),
            F.max(c.week).alias("last_week"),
            F.sum("value").alias("revenue"),
            F.avg("value").alias("avg_weekly_revenue"),
        )
    )
    base = df.agg(F.count_distinct(c.store).alias("stores"), F.count_distinct(c.item).alias("items"))
    return base.withColumns(
        {n: weeks[n] for n in ("weeks", "first_week", "last_week", "revenue", "avg_weekly_revenue")}
    )


def sales_split(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Records with and without sales."""
    rows, sold = F.count(F.lit(1)), F.count_if(F.col(c.sales) > 0)
    return df.agg(
        sold.alias("with_sales"),
        (rows - sold).alias("without_sales"),
        (F.try_divide(sold, rows) * 100).alias("with_sales_pct"),
        (F.try_divide(rows - sold, rows) * 100).alias("without_sales_pct"),
    )


def stock_split(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Records in and out of stock."""
    rows = F.count(F.lit(1))
    inside, outside = F.count_if(F.col(c.onhand) > 0), F.count_if(F.col(c.onhand) == 0)
    return df.agg(
        inside.alias("in_stock"),
        outside.alias("out_of_stock"),
        (F.try_divide(inside, rows) * 100).alias("in_stock_pct"),
        (F.try_divide(outside, rows) * 100).alias("out_of_stock_pct"),
    )


def sales_overview(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return describe(df, [c.sales, c.qty])


def inventory_overview(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return describe(df, [c.onhand, c.transit])


def top_stores(df: DataFrame, column: str, k: int = 5, c: SalesColumns = C) -> DataFrame:
    """Stores with the highest total of ``column``."""
    return top_rows(numbers_by(df, [c.store], {"total": total(column)}), "total", c.store, k)


# ---- stores ----------------------------------------------------------------

def store_performance(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return numbers_by(
        df,
        [c.store],
        {
            "revenue": total(c.sales),
            "avg_sales": F.avg(c.sales),
            "std_sales": F.stddev_samp(c.sales),
            "records": F.count(c.sales),
            "units": total(c.qty),
            "avg_units": F.avg(c.qty),
            "avg_inventory": F.avg(c.onhand),
        },
    )


def store_ranking(df: DataFrame, top: int = 10, bottom: int = 5, c: SalesColumns = C) -> DataFrame:
    per = store_performance(df, c).select(c.store, "revenue")
    return both_ends(per, "revenue", c.store, bottom, top)


def store_consistency(df: DataFrame, k: int = 5, c: SalesColumns = C) -> DataFrame:
    """Stores with the lowest and highest coefficient of variation of sales."""
    return both_ends(numbers_by(df, [c.store], {"cv": variation(c.sales)}), "cv", c.store, k)


def store_summary_stats(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    per = numbers_by(df, [c.store], {"revenue": total(c.sales)})
    return per.agg(
        F.count(F.lit(1)).alias("stores"),
        F.avg("revenue").alias("mean"),
        F.min("revenue").alias("min"),
        F.max("revenue").alias("max"),
        F.stddev_samp("revenue").alias("std"),
        F.try_divide(F.max("revenue"), F.min("revenue")).alias("max_to_min"),
    )


# ---- products --------------------------------------------------------------

def product_performance(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return numbers_by(
        df,
        [c.item],
        {
            "revenue": total(c.sales),
            "avg_sales": F.avg(c.sales),
            "records": F.count(c.sales),
            "units": total(c.qty),
            "avg_units": F.avg(c.qty),
            "avg_inventory": F.avg(c.onhand),
        },
    )


def product_ranking(df: DataFrame, k: int = 10, c: SalesColumns = C) -> DataFrame:
    """Top ``k`` items by revenue and bottom ``k`` above zero."""
    per = numbers_by(df, [c.item], {"revenue": total(c.sales)})
    top = top_rows(per, "revenue", c.item, k).withColumn("side", F.lit("highest"))
    low = top_rows(per.where("revenue > 0"), "revenue", c.item, k, lowest=True)
    return top.unionByName(low.withColumn("side", F.lit("lowest")))


def item_stats(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Revenue and coefficient of variation (missing as 0) per item, from one pass."""
    per = numbers_by(df, [c.item], {"revenue": total(c.sales), "cv": variation(c.sales)})
    return per.withColumn("cv", F.coalesce("cv", F.lit(0.0)))


# Cumulative-percent limits of the revenue classes.
ABC_LIMITS = (80, 95)


def abc_classes(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return _abc(numbers_by(df, [c.item], {"revenue": total(c.sales)}), c)


def _abc(stats: DataFrame, c: SalesColumns) -> DataFrame:
    first, second = ABC_LIMITS
    shares = cumulative_share(stats, c.item, "revenue")
    pct = F.col("cum_pct")
    label = F.when(pct <= first, "A").when(pct <= second, "B").otherwise("C")
    return shares.select(c.item, "revenue", "total_value", "cum_pct", label.alias("abc_class"))


def _thirds(stats: DataFrame, labels: Sequence[str], out: str) -> DataFrame:
    stats = materialize(stats)  # one row per item
    q = quantile_row(stats, "cv", [0.33, 0.67])
    low, mid, high = labels
    label = F.when(F.col("cv") <= q["q33"], low).when(F.col("cv") <= q["q67"], mid).otherwise(high)
    return stats.withColumn(out, label)


def xyz_classes(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return _thirds(item_stats(df, c), ("X", "Y", "Z"), "xyz_class").select(c.item, "cv", "xyz_class")


def demand_variability(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Thirds of the coefficient of variation per item."""
    return _thirds(item_stats(df, c), ("Predictable", "Variable", "Highly Variable"), "variability_class").select(
        c.item, "cv", "variability_class"
    )


# Strategy texts per class pair.
ABC_XYZ_TEXTS = {
    "AX": "Key products - maintain high service levels",
    "AY": "Important but variable - improve forecasting",
    "AZ": "High value, unpredictable - safety stock strategy",
    "B": "Medium importance - standard management",
    "C": "Low priority - consider discontinuation",
}


def abc_xyz_matrix(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Items, revenue, revenue percent and strategy per revenue class and variability class."""
    stats = materialize(item_stats(df, c))  # one row per item, read by both classifications
    abc = _abc(stats.select(c.item, "revenue"), c)
    xyz = _thirds(stats.select(c.item, "cv"), ("X", "Y", "Z"), "xyz_class")
    pair = F.concat("abc_class", "xyz_class")
    cells = (
        abc.join(xyz, c.item)
        .groupBy(pair.alias("abc_xyz"))
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum("revenue").alias("revenue"),
            (F.try_divide(F.sum("revenue"), F.max("total_value")) * 100).alias("revenue_pct"),
        )
    )
    text = F.lit(ABC_XYZ_TEXTS["C"])
    for code in ("B", "AZ", "AY", "AX"):
        text = F.when(F.startswith("abc_xyz", F.lit(code)), ABC_XYZ_TEXTS[code]).otherwise(text)
    return cells.withColumn("strategy", text)


def velocity_classes(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Items fast (units above the median) or slow."""
    per = materialize(numbers_by(df, [c.item], {"units": total(c.qty)}))
    fast = F.col("units") > quantile_row(per, "units", [0.5])["q50"]
    return per.withColumn("velocity", F.when(fast, "fast").otherwise("slow"))


def top_pct_share(df: DataFrame, share: float = 0.2, c: SalesColumns = C) -> DataFrame:
    """Revenue share of the top ``int(items * share)`` items."""
    return _top_share(numbers_by(df, [c.item], {"revenue": total(c.sales)}), share, c)


def _top_share(stats: DataFrame, share: float, c: SalesColumns) -> DataFrame:
    ranked = cumulative_share(stats, c.item, "revenue")
    limit = F.floor(F.col("entities") * F.lit(share))
    inside = F.col("position") <= limit
    revenue = F.coalesce(F.sum(F.when(inside, F.col("revenue"))), F.lit(0.0))
    return ranked.agg(
        F.count_if(inside).alias("top_items"),
        F.when(F.max("total_value") > 0, revenue / F.max("total_value") * 100).otherwise(0.0).alias("top_share_pct"),
    )


def lifecycle_stage(df: DataFrame, min_weeks: int = 8, c: SalesColumns = C) -> DataFrame:
    """Growth, Mature or Decline per item: mean of the later half of its weeks over the earlier."""
    w = in_order(c.week, [c.item])
    series = weekly(df, c.week, c.sales, by=[c.item]).withColumns(
        {"n": F.count(F.lit(1)).over(whole([c.item])), "rn": F.row_number().over(w)}
    )
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    halves = (
        series.where(F.col("n") >= min_weeks)
        .groupBy(c.item)
        .agg(
            F.avg(F.when(early, F.col("value"))).alias("first_half"),
            F.avg(F.when(~early, F.col("value"))).alias("second_half"),
            F.sum("value").alias("total_sales"),
        )
    )
    first, second = F.col("first_half"), F.col("second_half")
    return halves.select(
        c.item,
        F.when(second > first * 1.2, "Growth").when(second < first * 0.8, "Decline").otherwise("Mature").alias("stage"),
        "total_sales",
        F.when(first > 0, second / first).otherwise(1.0).alias("trend_ratio"),
    )


# ---- time ------------------------------------------------------------------

def weekly_performance(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    return numbers_by(
        df,
        [c.week],
        {
            "revenue": total(c.sales),
            "avg_sales": F.avg(c.sales),
            "records": F.count(c.sales),
            "units": total(c.qty),
            "avg_inventory": F.avg(c.onhand),
        },
    )


def growth_analysis(df: DataFrame, by: Sequence[str] = (), c: SalesColumns = C) -> DataFrame:
    """Mean and deviation of week-over-week growth in percent, best and worst week."""
    before = F.lag("value").over(in_order(c.week, by))
    series = weekly(df, c.week, c.sales, by=by).withColumn("growth", ratio(F.col("value") - before, before, 100.0))
    return series.groupBy(*by).agg(
        F.avg("growth").alias("avg_growth_pct"),
        F.stddev_samp("growth").alias("growth_std_pct"),
        key_of_max(c.week, "value").alias("best_week"),
        F.max("value").alias("best_revenue"),
        key_of_min(c.week, "value").alias("worst_week"),
        F.min("value").alias("worst_revenue"),
    )


def seasonal_sales(df: DataFrame, min_weeks: int = 50, c: SalesColumns = C) -> DataFrame:
    """Peak and low week of year by total sales; empty with fewer than ``min_weeks`` weeks."""
    series = weekly(df, c.week, c.sales)
    weeks = series.agg(F.count(F.lit(1)).alias("n")).scalar()
    season = series.groupBy((F.col(c.week) % 100).alias("week")).agg(F.sum("value").alias("value"))
    out = season.agg(
        key_of_max("week", "value").alias("peak_week"),
        key_of_min("week", "value").alias("low_week"),
        ((F.try_divide(F.max("value"), F.min("value")) - 1) * 100).alias("variation_pct"),
    )
    return out.where(weeks >= min_weeks)


def demand_characteristics(df: DataFrame, min_weeks: int = 12, by: Sequence[str] = (), c: SalesColumns = C) -> DataFrame:
    out = weekly(df, c.week, c.sales, by=by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg("value").alias("mean_demand"),
        F.stddev_samp("value").alias("std_demand"),
        variation("value").alias("cv"),
    )
    return out.where(F.col("weeks") >= min_weeks)


def seasonal_cv(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Variation of the week-of-year totals, with peak and low week."""
    season = weekly(df.withColumn("_woy", F.col(c.week) % 100), "_woy", c.sales)
    return season.agg(
        variation("value").alias("seasonal_cv"),
        key_of_max("_woy", "value").alias("peak_week"),
        key_of_min("_woy", "value").alias("low_week"),
    )


def forecast_proxy(
    df: DataFrame, first: int = 12, last: int = 8, min_weeks: int = 20, by: Sequence[str] = (), c: SalesColumns = C
) -> DataFrame:
    """Deviation in percent of the mean of the last weeks from the mean of the first weeks."""
    series = weekly(df, c.week, c.sales, by=by).withColumns(
        {"rn": F.row_number().over(in_order(c.week, by)), "n": F.count(F.lit(1)).over(whole(by))}
    )
    out = series.groupBy(*by).agg(
        F.max("n").alias("weeks"),
        F.avg(F.when(F.col("rn") > F.col("n") - last, F.col("value"))).alias("recent_avg"),
        F.avg(F.when(F.col("rn") <= first, F.col("value"))).alias("historical_avg"),
    )
    gap = ratio(F.abs(F.col("recent_avg") - F.col("historical_avg")), F.col("historical_avg"), 100.0)
    return out.where(F.col("weeks") >= min_weeks).withColumn("deviation_pct", gap)


# ---- inventory -------------------------------------------------------------

def inventory_efficiency(df: DataFrame, k: int = 5, c: SalesColumns = C) -> DataFrame:
    """Total sales over mean inventory per store: lowest and highest ``k``."""
    per = numbers_by(df, [c.store], {"efficiency": ratio(F.sum(c.sales), F.avg(c.onhand))})
    return both_ends(per, "efficiency", c.store, k)


def _rate_per_store(df: DataFrame, hit, name: str, worst: int | None, c: SalesColumns) -> DataFrame:
    per = numbers_by(df, [c.store], {f"{name}_count": F.count_if(hit), "records": F.count(F.lit(1))})
    per = per.withColumn(f"{name}_rate", F.col(f"{name}_count") / F.col("records") * 100)
    mean = per.agg(F.avg(f"{name}_rate").alias("m")).scalar()
    per = per.withColumn("average_rate", mean)
    return per if worst is None else top_rows(per, f"{name}_rate", c.store, worst)


def stockout_rate(df: DataFrame, worst: int | None = None, c: SalesColumns = C) -> DataFrame:
    return _rate_per_store(df, F.col(c.onhand) == 0, "stockout", worst, c)


def overstock_rate(df: DataFrame, worst: int | None = None, c: SalesColumns = C) -> DataFrame:
    """Share of records above the upper quartile of inventory, per store."""
    limit = quantile_row(df, c.onhand, [0.75])["q75"]
    return _rate_per_store(df, F.col(c.onhand) > limit, "overstock", worst, c)


# Labels of the efficiency quartiles, lowest first.
EFFICIENCY_LABELS = ("Low Efficiency", "Medium-Low", "Medium-High", "High Efficiency")


def _moving(df: DataFrame, c: SalesColumns) -> DataFrame:
    return df.where((F.col(c.sales) > 0) & (F.col(c.onhand) > 0))


def efficiency_quartiles(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Records with sales and stock, split by quartile edges of the sales-to-inventory ratio."""
    data = _moving(df, c)
    q = quantile_row(data, c.ratio, [0.25, 0.5, 0.75])
    below = F.lit(float("-inf"))
    label = bins(F.col(c.ratio), [below, q["q25"], q["q50"], q["q75"], None], EFFICIENCY_LABELS)
    return data.groupBy(label.alias("quartile")).agg(
        F.avg(c.sales).alias("avg_sales"),
        F.count(c.sales).alias("records"),
        F.avg(c.onhand).alias("avg_inventory"),
        F.avg(c.ratio).alias("avg_ratio"),
    )


def store_efficiency_ranking(df: DataFrame, k: int = 5, c: SalesColumns = C) -> DataFrame:
    per = numbers_by(_moving(df, c), [c.store], {"avg_ratio": F.avg(c.ratio)})
    return both_ends(per, "avg_ratio", c.store, k)


def inventory_turnover(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Units sold over mean inventory (plus 0.1) per store and item."""
    turnover = ratio(F.sum(c.qty), F.avg(c.onhand) + F.lit(0.1))
    return numbers_by(df, [c.store, c.item], {"turnover": turnover}).where(F.col("turnover").isNotNull())


def turnover_summary(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    per = materialize(inventory_turnover(df, c))
    median = quantile_row(per, "turnover", [0.5])["q50"]
    return per.agg(F.count(F.lit(1)).alias("pairs"), F.avg("turnover").alias("avg_turnover")).withColumn(
        "median_turnover", median
    )


def turnover_extremes(df: DataFrame, k: int = 10, c: SalesColumns = C) -> DataFrame:
    return both_ends(inventory_turnover(df, c), "turnover", [c.store, c.item], k)


def service_level(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """Percent of periods not out of stock, per store and item."""
    per = numbers_by(df, [c.store, c.item], {"stockouts": F.count_if(F.col(c.onhand) == 0), "periods": F.count(c.onhand)})
    return per.withColumn("service_level", (1 - F.try_divide("stockouts", "periods")) * 100)


def service_summary(df: DataFrame, limit: float = 90.0, c: SalesColumns = C) -> DataFrame:
    return service_level(df, c).agg(
        F.avg("service_level").alias("avg_service_level"),
        F.count_if(F.col("service_level") < limit).alias("low_service_pairs"),
    )


def inventory_kpis(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    stockouts = F.count_if(F.col(c.onhand) == 0)
    return numbers_by(
        df,
        [c.store],
        {
            "revenue": total(c.sales),
            "avg_sales": F.avg(c.sales),
            "avg_inventory": F.avg(c.onhand),
            "std_inventory": F.stddev_samp(c.onhand),
            "stockouts": stockouts,
            "turnover": ratio(F.sum(c.sales), F.avg(c.onhand)),
            "service_level": 1 - F.try_divide(stockouts, F.count(F.lit(1))),
        },
    )


# ---- report ----------------------------------------------------------------

# Recommendation texts.
ADVICE = {
    "stockout_high": "High stockout rate detected - review inventory planning",
    "stockout_low": "Very low stockout rate - consider inventory reduction",
    "many_stores": "Multi-store network - implement store benchmarking program",
    "many_items": "Large product portfolio - consider ABC analysis for optimization",
}


def sales_report(df: DataFrame, c: SalesColumns = C) -> DataFrame:
    """One-row business summary with recommendations joined by '; '.

    The fact is read once: totals per store, per item, per week and over all come from one pass of
    grouping sets and are kept, a row for each key.
    """
    keys = (c.store, c.item, c.week)
    folded = df.groupingSets([[c.store], [c.item], [c.week], []], *keys).agg(
        F.grouping_id().alias("_level"),
        total(c.sales).alias("revenue"),
        total(c.qty).alias("units"),
        F.avg(c.onhand).alias("avg_inventory"),
        (rate(F.coalesce(F.col(c.onhand) == 0, F.lit(False))) * 100).alias("stockout_rate_pct"),
        F.avg(c.ratio).alias("avg_ratio"),
    )
    folded = materialize(folded)
    # the level's bits say which of (store, item, week) is summed over
    by_store, by_item, by_week = (
        folded.where((F.col("_level") == level) & F.col(key).isNotNull()) for level, key in zip((3, 5, 6), keys)
    )
    stores = scalar_row(
        by_store.agg(
            F.count(F.lit(1)).alias("stores"),
            key_of_max(c.store, "revenue").alias("top_store"),
            F.max("revenue").alias("top_store_revenue"),
        )
    )
    items = by_item.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = _top_share(by_item.select(c.item, "revenue"), 0.2, c).select("top_share_pct").scalar()
    levels = scalar_row(folded.where("_level = 7").select("units", "avg_inventory", "stockout_rate_pct", "avg_ratio"))
    weeks = by_week.agg(
        F.count(F.lit(1)).alias("weeks"),
        F.min(c.week).alias("first_week"),
        F.max(c.week).alias("last_week"),
        F.sum("revenue").alias("revenue"),
        F.avg("revenue").alias("avg_weekly_revenue"),
    )
    out = weeks.select(
        stores["stores"].alias("stores"), items.alias("items"), "weeks", "first_week", "last_week", "revenue", "avg_weekly_revenue"
    ).withColumns(
        {
            "top_store": stores["top_store"],
            "top_store_revenue": stores["top_store_revenue"],
            **{n: levels[n] for n in ("units", "avg_inventory", "stockout_rate_pct", "avg_ratio")},
            "top_20pct_share": share,
        }
    )
    advice = [
        F.when(F.col("stockout_rate_pct") > 10, ADVICE["stockout_high"]).when(
            F.col("stockout_rate_pct") < 2, ADVICE["stockout_low"]
        ),
        F.when(F.col("stores") > 5, ADVICE["many_stores"]),
        F.when(F.col("items") > 1000, ADVICE["many_items"]),
    ]
    return out.withColumn("recommendations", F.concat_ws("; ", *advice))
