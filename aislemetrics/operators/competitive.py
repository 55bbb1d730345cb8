"""Competitor price-match analysis: own price, competitor price, gap, win/draw/loss flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import correlation, describe, numbers_by
from ..functions.columns import has_keys, is_value, rate, ratio
from ..session import scalar_row
from .series import in_order, whole

OWN, RIVAL, GAP, WEEK = "base_unit_retail_amt", "comp_reg", "reg_price_gap", "wm_week"


def price_match_corr(df: DataFrame) -> DataFrame:
    return df.agg(correlation(F.col(OWN), F.col(RIVAL)).alias("correlation"))


def gap_describe(df: DataFrame) -> DataFrame:
    return describe(df, [GAP])


def _yes(column: str, value: str = "Y"):
    return is_value(F.col(column), value)


def win_rates(df: DataFrame) -> DataFrame:
    """Win, draw and loss rates in percent from three flags."""
    return df.agg(
        *[(rate(_yes(f"item_{k}")) * 100).alias(f"{k}_rate_pct") for k in ("win", "draw", "loss")]
    )


def win_loss_rates(df: DataFrame) -> DataFrame:
    """Win and loss rates in percent from the one win flag (Y or N)."""
    return df.agg(
        (rate(_yes("item_win")) * 100).alias("win_rate_pct"), (rate(_yes("item_win", "N")) * 100).alias("loss_rate_pct")
    )


def by_banner(df: DataFrame) -> DataFrame:
    return numbers_by(
        df,
        ["banner_name"],
        {
            "avg_rival": F.avg(RIVAL),
            "records": F.count(RIVAL),
            "std_rival": F.stddev_samp(RIVAL),
            "avg_gap": F.avg(GAP),
        },
    )


def by_region(df: DataFrame, region: str = "hg_region") -> DataFrame:
    return numbers_by(
        df,
        [region],
        {"avg_price": F.avg(OWN), "records": F.count(OWN), "std_price": F.stddev_samp(OWN), "avg_gap": F.avg(GAP)},
        {"median_price": OWN},
    )


def by_brand_type(df: DataFrame) -> DataFrame:
    return numbers_by(df, ["brand_type"], {"avg_price": F.avg(OWN), "records": F.count(OWN), "avg_gap": F.avg(GAP)})


def weekly_trend(df: DataFrame) -> DataFrame:
    return numbers_by(
        df,
        [WEEK],
        {"avg_price": F.avg(OWN), "records": F.count(OWN), "avg_rival": F.avg(RIVAL), "avg_gap": F.avg(GAP)},
    )


def region_brand(df: DataFrame, region: str = "hg_region") -> DataFrame:
    return numbers_by(
        df,
        [region, "brand_type"],
        {
            "avg_price": F.avg(OWN),
            "records": F.count(OWN),
            "std_price": F.stddev_samp(OWN),
            "avg_gap": F.avg(GAP),
            "wins": F.count_if(_yes("item_win")),
            "win_rate": rate(_yes("item_win")),
        },
    )


def interaction_matrix(df: DataFrame, region: str = "hg_region") -> DataFrame:
    """Mean gap per region and brand type, one row for each pair that occurs.

    ``functions.columns.crosstab`` turns it into a matrix with the brand types found as columns.
    """
    return numbers_by(has_keys(df, region, "brand_type"), [region, "brand_type"], {"avg_gap": F.avg(GAP)})


def panel_variance(df: DataFrame, store: str = "hg_store_id") -> DataFrame:
    """Variance of store means, mean variance inside stores, and their ratio."""
    per = numbers_by(df, [store], {"m": F.avg(OWN), "v": F.var_samp(OWN)})
    return per.agg(
        F.var_samp("m").alias("between_var"),
        F.avg("v").alias("within_var"),
        F.try_divide(F.var_samp("m"), F.avg("v")).alias("ratio"),
    )


def variance_decomposition(df: DataFrame, groups: Sequence[str] = ("hg_region", "brand_type", "banner_name")) -> DataFrame:
    """Variance of the group means over the total variance, per grouping, from one scan."""
    keys = [g for g in groups if g in df.columns]
    # fold to one row per key combination before fanning out to one row per grouping
    folded = df.groupBy(*keys).agg(F.sum(OWN).alias("s"), F.count(OWN).alias("n"))
    long = folded.unpivot(["s", "n"], keys, "grouping", "key").where(F.col("key").isNotNull())
    means = long.groupBy("grouping", "key").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    total_var = df.agg(F.var_samp(OWN).alias("v")).scalar()
    return (
        means.groupBy("grouping")
        .agg(F.var_samp("m").alias("between_var"))
        .withColumn("share", F.try_divide(F.col("between_var"), total_var))
    )


def regional_trend(df: DataFrame, region: str = "hg_region") -> DataFrame:
    """Weekly mean price per region beside the overall mean price."""
    overall = df.agg(F.avg(OWN).alias("m")).scalar()
    return numbers_by(df, [region, WEEK], {"avg_price": F.avg(OWN)}).withColumn("overall_avg", overall)


def competitive_report(df: DataFrame, region: str = "hg_region") -> DataFrame:
    """One-row summary: prices, gap, share priced higher, win rate, regions, weeks."""
    modal = scalar_row(
        has_keys(df, region)
        .groupBy(region)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.min_by(region, F.struct(-F.col("n"), F.col(region))).alias("region"))
    )
    higher = F.count_if(F.col(GAP) > 0)
    base = df.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(OWN).alias("avg_price"),
        (F.max(OWN) - F.min(OWN)).alias("price_range"),
        F.avg(GAP).alias("avg_gap"),
        (F.try_divide(higher, F.count(GAP)) * 100).alias("higher_priced_pct"),
        (rate(_yes("item_win")) * 100).alias("win_rate_pct"),
        F.count_distinct(region).alias("regions"),
        F.count_distinct(WEEK).alias("weeks"),
        F.min(WEEK).alias("first_week"),
        F.max(WEEK).alias("last_week"),
    )
    return base.withColumn("top_region", modal["region"])


def response_timing(df: DataFrame, week: str = WEEK, by: Sequence[str] = ()) -> DataFrame:
    """Weeks with an own price change beyond one deviation, and the rival change in week + 1.

    The rival's week must be exactly the next code, so a gap in the weeks gives no pair.
    """
    series = numbers_by(df, [*by, week], {"own": F.avg(OWN), "rival": F.avg(RIVAL)})
    w = in_order(week, by)

    def change(c):
        return ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w))

    changes = series.withColumns({"own_change": change("own"), "rival_change": change("rival")})
    marked = changes.withColumns(
        {
            "limit": F.stddev_samp("own_change").over(whole(by)),
            "next_week": F.lead(week).over(w),
            "response": F.lead("rival_change").over(w),
        }
    )
    hits = marked.where((F.abs("own_change") > F.col("limit")) & (F.col("next_week") == F.col(week) + 1))
    same = F.coalesce(F.col("own_change") * F.col("response") > 0, F.lit(False))
    return hits.select(*by, week, "own_change", "response", same.alias("same_direction"))


def response_summary(responses: DataFrame) -> DataFrame:
    return responses.agg(
        F.count(F.lit(1)).alias("responses"),
        (rate(F.col("same_direction")) * 100).alias("same_direction_pct"),
    )
