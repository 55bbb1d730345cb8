"""Store price analysis. Inputs are frames from ``prepare.with_price_metrics``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import describe, key_of_max, key_of_min, numbers_by, variation
from ..functions.columns import cycle_week, has_keys, rate
from ..functions.running import quantiles_row
from ..session import materialize, scalar_row
from .prepare import with_category
from .quality import value_counts
from .series import both_ends, top_rows, whole

PRICE, GAP, PROMO = "live_price_amt", "gap_reg_live", "on_promotion"


def _promo_rate():
    return rate(F.col(PROMO))


def geo_coverage(df: DataFrame) -> DataFrame:
    """Records, their share and distinct stores per province."""
    records = value_counts(df, "prov_cd")
    stores = has_keys(df, "prov_cd").groupBy("prov_cd").agg(F.count_distinct("store_nbr").alias("stores"))
    return records.join(stores, "prov_cd")


def region_records(df: DataFrame) -> DataFrame:
    return value_counts(df, "region_nm")


def pricing_overview(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distribution of the price columns and of the regular-minus-live gap."""
    return describe(df, columns or [PRICE, "defined_reg_price_amt", GAP])


def promotion_rate(df: DataFrame) -> DataFrame:
    return df.agg((_promo_rate() * 100).alias("promo_rate_pct"))


def province_stats(df: DataFrame) -> DataFrame:
    return numbers_by(
        df,
        ["prov_cd"],
        {
            "avg_price": F.avg(PRICE),
            "std_price": F.stddev_samp(PRICE),
            "records": F.count(PRICE),
            "avg_gap": F.avg(GAP),
            "promo_rate": _promo_rate(),
        },
        {"median_price": PRICE},
    )


def weekly_price_stats(df: DataFrame, week: str = "wm_wk_nbr") -> DataFrame:
    return numbers_by(
        df,
        [week],
        {
            "avg_price": F.avg(PRICE),
            "std_price": F.stddev_samp(PRICE),
            "records": F.count(PRICE),
            "avg_gap": F.avg(GAP),
            "promo_rate": _promo_rate(),
        },
    )


def promo_split(df: DataFrame) -> DataFrame:
    """Records on and off promotion with their share."""
    return value_counts(df, PROMO)


def promo_rate_by(df: DataFrame, dim: str) -> DataFrame:
    return numbers_by(df, [dim], {"promo_rate_pct": _promo_rate() * 100})


def promo_extremes(df: DataFrame, dim: str = "wm_wk_nbr") -> DataFrame:
    """Keys with the highest and lowest promotion rate and the deviation between keys."""
    return promo_rate_by(df, dim).agg(
        key_of_max(dim, "promo_rate_pct").alias("peak"),
        F.max("promo_rate_pct").alias("peak_rate_pct"),
        key_of_min(dim, "promo_rate_pct").alias("low"),
        F.min("promo_rate_pct").alias("low_rate_pct"),
        F.stddev_samp("promo_rate_pct").alias("std_pct"),
    )


def discount_comparison(df: DataFrame) -> DataFrame:
    """Mean gap on and off promotion."""
    return numbers_by(df, [PROMO], {"avg_gap": F.avg(GAP), "records": F.count(GAP)})


def store_price_stats(df: DataFrame) -> DataFrame:
    return numbers_by(
        df,
        ["store_nbr"],
        {
            "avg_price": F.avg(PRICE),
            "std_price": F.stddev_samp(PRICE),
            "records": F.count(PRICE),
            "items": F.count_distinct("item_nbr"),
            "avg_gap": F.avg(GAP),
            "promo_rate": _promo_rate(),
        },
    )


def largest_stores(df: DataFrame, by: str = "records", k: int = 10) -> DataFrame:
    """The ``k`` stores with the most ``records`` or distinct ``items``."""
    return top_rows(store_price_stats(df), by, "store_nbr", k)


def store_price_rank(df: DataFrame, k: int = 5) -> DataFrame:
    return both_ends(numbers_by(df, ["store_nbr"], {"avg_price": F.avg(PRICE)}), "avg_price", "store_nbr", k)


def store_price_consistency(df: DataFrame, k: int = 5) -> DataFrame:
    """Stores with the lowest price deviation."""
    per = numbers_by(df, ["store_nbr"], {"std_price": F.stddev_samp(PRICE)})
    return top_rows(per, "std_price", "store_nbr", k, lowest=True)


def regional_gradient(df: DataFrame, region: str = "region_nm") -> DataFrame:
    """Range of the mean price across regions and the regions at both ends."""
    return numbers_by(df, [region], {"avg_price": F.avg(PRICE)}).agg(
        (F.max("avg_price") - F.min("avg_price")).alias("price_range"),
        key_of_min(region, "avg_price").alias("lowest_region"),
        F.min("avg_price").alias("lowest_price"),
        key_of_max(region, "avg_price").alias("highest_region"),
        F.max("avg_price").alias("highest_price"),
    )


def pricing_strategy(df: DataFrame) -> DataFrame:
    """Stores by price level and promotion level against the medians (means rounded to 3 first)."""
    per = numbers_by(
        df,
        ["store_nbr"],
        {
            "avg_price": F.round(F.avg(PRICE), 3),
            "promo_rate": F.round(_promo_rate(), 3),
            "avg_gap": F.round(F.avg(GAP), 3),
        },
    )
    per = materialize(per)  # one row per store, read for the medians and again for the result
    median = quantiles_row(per, ["avg_price", "promo_rate"])
    dear, often = F.col("avg_price") > median["avg_price"], F.col("promo_rate") > median["promo_rate"]
    # fixed values: the four strategy labels
    label = (
        F.when(dear & ~often, "Premium").when(~dear & ~often, "EDLP").when(dear & often, "Hi-Lo").otherwise("Discount")
    )
    return per.withColumn("strategy", label)


def strategy_performance(stores: DataFrame) -> DataFrame:
    """Stores, their share and mean figures per strategy (from :func:`pricing_strategy`)."""
    rows = stores.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stores.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("stores"),
        (F.try_divide(F.count(F.lit(1)), F.first(rows)) * 100).alias("stores_pct"),
        F.avg("avg_price").alias("avg_price"),
        F.avg("promo_rate").alias("promo_rate"),
        F.avg("avg_gap").alias("avg_gap"),
    )


def item_price_cv(df: DataFrame, item: str = "item_nbr") -> DataFrame:
    """Coefficient of variation of the price per item; items without one are dropped."""
    return numbers_by(df, [item], {"cv": variation(PRICE)}).where(F.col("cv").isNotNull())


def price_consistency_by_item(df: DataFrame, k: int = 5) -> DataFrame:
    """Lowest and highest ``k`` items by price variation, beside the mean over all items."""
    per = item_price_cv(df)
    return both_ends(per, "cv", "item_nbr", k).withColumn("avg_cv", per.agg(F.avg("cv").alias("m")).scalar())


def seasonal_promotion(df: DataFrame, week: str = "wm_wk_nbr") -> DataFrame:
    """Promotion rate per week of the 52-week cycle."""
    return promo_rate_by(df.withColumn("season_week", cycle_week(F.col(week))), "season_week")


def seasonal_promotion_extremes(df: DataFrame, k: int = 5) -> DataFrame:
    return both_ends(seasonal_promotion(df), "promo_rate_pct", "season_week", k)


def product_volatility(df: DataFrame, min_records: int = 5) -> DataFrame:
    """Price variation per item (missing as 0) for items with more than ``min_records`` prices."""
    per = numbers_by(
        df,
        ["item_nbr"],
        {
            "avg_price": F.avg(PRICE),
            "std_price": F.stddev_samp(PRICE),
            "records": F.count(PRICE),
            "cv": F.coalesce(variation(PRICE), F.lit(0.0)),
        },
    )
    return per.where(F.col("records") > min_records)


def volatility_extremes(df: DataFrame, k: int = 10) -> DataFrame:
    return both_ends(product_volatility(df), "cv", "item_nbr", k)


def category_analysis(df: DataFrame) -> DataFrame:
    """Mean price, promotion percent, mean gap and distinct items per category, dearest first."""
    per = numbers_by(
        with_category(df),
        ["product_category"],
        {
            "avg_price": F.avg(PRICE),
            "promo_rate_pct": _promo_rate() * 100,
            "avg_gap": F.avg(GAP),
            "items": F.count_distinct("item_nbr"),
        },
    )
    return per.orderBy(F.desc("avg_price"))


def pricing_report(df: DataFrame) -> DataFrame:
    """One-row summary: volume, prices, promotion rate, extreme provinces, weeks."""
    provinces = scalar_row(
        numbers_by(df, ["prov_cd"], {"p": F.avg(PRICE)}).agg(
            key_of_max("prov_cd", "p").alias("highest_province"),
            F.max("p").alias("highest_price"),
            key_of_min("prov_cd", "p").alias("lowest_province"),
            F.min("p").alias("lowest_price"),
        )
    )
    base = df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("item_nbr").alias("items"),
        F.count_distinct("store_nbr").alias("stores"),
        F.count_distinct("wm_wk_nbr").alias("weeks"),
        F.count_distinct("prov_cd").alias("provinces"),
        F.avg(PRICE).alias("avg_price"),
        (F.max(PRICE) - F.min(PRICE)).alias("price_range"),
        (_promo_rate() * 100).alias("promo_rate_pct"),
        F.min("wm_wk_nbr").alias("first_week"),
        F.max("wm_wk_nbr").alias("last_week"),
    )
    return base.withColumns(
        {n: provinces[n] for n in ("highest_province", "highest_price", "lowest_province", "lowest_price")}
    )


def price_series(df: DataFrame, week: str = "wm_wk_nbr", by: tuple[str, ...] = ()) -> DataFrame:
    """Weekly mean price beside the mean over the whole series."""
    per = numbers_by(df, [*by, week], {"value": F.avg(PRICE)})
    return per.withColumn("series_avg", F.avg("value").over(whole(by)))
