"""Weekly series analysis. Extra keys in ``by`` run one series per key, all in parallel.

Windows here span one series, whose length is its number of weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import correlation, key_of_max, key_of_min, numbers_by, variation
from ..functions.columns import cycle_week, ratio
from ..functions.pvalues import t_pvalue
from .series import in_order, weekly, whole

Keys = Sequence[str]


def series(df: DataFrame, week: str, value: str, how: str = "mean", by: Keys = ()) -> DataFrame:
    """Weekly series with its 0-based position ``pos`` and length ``n``."""
    return weekly(df, week, value, how, by).withColumns(
        {"pos": F.row_number().over(in_order(week, by)) - 1, "n": F.count(F.lit(1)).over(whole(by))}
    )


def linear_trend(s: DataFrame, by: Keys = (), min_weeks: int = 20) -> DataFrame:
    """Least-squares slope and intercept against the position."""
    out = s.groupBy(*by).agg(
        F.count("value").alias("weeks"),
        F.regr_slope("value", "pos").alias("slope"),
        F.regr_intercept("value", "pos").alias("intercept"),
    )
    return out.where(F.col("weeks") >= min_weeks)


def trend_test(s: DataFrame, by: Keys = (), min_weeks: int = 12, level: float = 0.05) -> DataFrame:
    """Slope, R squared and p-value of the trend."""
    fit = s.groupBy(*by).agg(
        F.count("value").alias("weeks"),
        F.regr_slope("value", "pos").alias("slope"),
        F.regr_intercept("value", "pos").alias("intercept"),
        F.regr_r2("value", "pos").alias("r2"),
    )
    df = F.col("weeks") - 2
    t = F.signum("slope") * F.sqrt(F.try_divide(F.col("r2") * df, F.greatest(1 - F.col("r2"), F.lit(0.0))))
    fit = fit.where(F.col("weeks") >= min_weeks).withColumn("t", t)
    return fit.withColumn("p_value", t_pvalue(F.col("t"), df)).withColumn("significant", F.col("p_value") < level)


def seasonal_pattern(s: DataFrame, week: str, by: Keys = (), one_based: bool = False, min_weeks: int = 52) -> DataFrame:
    """Mean value per week of the 52-week cycle."""
    enough = s.where(F.col("n") >= min_weeks)
    return enough.groupBy(*by, cycle_week(F.col(week), one_based).alias("cycle_week")).agg(
        F.avg("value").alias("value")
    )


def seasonal_extremes(pattern: DataFrame, by: Keys = ()) -> DataFrame:
    return pattern.groupBy(*by).agg(
        key_of_max("cycle_week", "value").alias("peak_week"),
        F.max("value").alias("peak_value"),
        key_of_min("cycle_week", "value").alias("trough_week"),
        F.min("value").alias("trough_value"),
    )


def seasonal_strength(s: DataFrame, week: str, min_weeks: int = 52) -> DataFrame:
    """Variance of the seasonal pattern over the variance of the series."""
    series_var = s.agg(F.var_samp("value").alias("v")).scalar()
    pattern = seasonal_pattern(s, week, min_weeks=min_weeks)
    out = pattern.agg(F.var_samp("value").alias("pattern_var")).where(F.col("pattern_var").isNotNull())
    return out.withColumn("strength", F.try_divide(F.col("pattern_var"), series_var))


def seasonal_index(s: DataFrame, by: Keys = ()) -> DataFrame:
    """Weekly value over the mean of its series."""
    return s.withColumn("index", ratio(F.col("value"), F.avg("value").over(whole(by))))


def seasonal_index_summary(indexed: DataFrame, week: str, by: Keys = ()) -> DataFrame:
    return indexed.groupBy(*by).agg(
        key_of_max(week, "index").alias("highest_week"),
        F.max("index").alias("highest_index"),
        key_of_min(week, "index").alias("lowest_week"),
        F.min("index").alias("lowest_index"),
        F.stddev_samp("index").alias("index_std"),
    )


def weekly_changes(s: DataFrame, week: str, by: Keys = ()) -> DataFrame:
    """Add the difference and the relative change to the week before."""
    before = F.lag("value").over(in_order(week, by))
    return s.withColumns({"diff": F.col("value") - before, "change": ratio(F.col("value") - before, before)})


def volatile_periods(s: DataFrame, week: str, by: Keys = (), k: float = 2.0) -> DataFrame:
    """Weeks whose relative change exceeds ``k`` deviations of the changes."""
    marked = weekly_changes(s, week, by).withColumn("limit", F.stddev_samp("change").over(whole(by)) * k)
    return marked.where(F.abs("change") > F.col("limit")).select(*by, week, "value", "change")


def volatile_summary(periods: DataFrame, week: str, by: Keys = ()) -> DataFrame:
    return periods.withColumn("size", F.abs("change")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg("change").alias("avg_change"),
        key_of_max(week, "size").alias("most_volatile_week"),
        F.max("size").alias("largest_change"),
    )


def weekly_cv(df: DataFrame, week: str, value: str) -> DataFrame:
    """Coefficient of variation inside each week; 0 for a mean of 0."""
    cv = F.when(F.avg(value) != 0, variation(value)).otherwise(0.0)
    return numbers_by(df, [week], {"cv": cv})


def mean_weekly_cv(df: DataFrame, week: str, value: str) -> DataFrame:
    return weekly_cv(df, week, value).agg(F.avg("cv").alias("avg_cv"))


def rolling_mean(s: DataFrame, week: str, by: Keys = (), width: int = 4) -> DataFrame:
    """Mean of the last ``width`` weeks (NULL until there are that many) and the trend line."""
    frame = in_order(week, by).rowsBetween(1 - width, 0)
    full = F.count("value").over(frame) == width
    slope = F.regr_slope("value", "pos").over(whole(by))
    start = F.regr_intercept("value", "pos").over(whole(by))
    return s.withColumns(
        {
            "rolling": F.when(full, F.avg("value").over(frame)),
            "trend_line": start + slope * F.col("pos"),
        }
    )


def _local_maxima(x: np.ndarray) -> np.ndarray:
    """Middle positions of runs that are higher than both neighbouring runs; ends never count."""
    if len(x) < 3:
        return np.array([], dtype=int)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    stops = np.r_[starts[1:], len(x)] - 1
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + stops[top]) // 2


def _spaced(places: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Keep the highest places such that kept ones are at least ``distance`` apart."""
    kept: list[int] = []
    for i in np.lexsort((places, height))[::-1]:
        if all(abs(places[i] - places[j]) >= distance for j in kept):
            kept.append(i)
    return np.sort(places[kept]) if kept else places[:0]


def peaks_troughs(
    s: DataFrame, week: str, by: Keys = (), distance: int = 4, above_mean: bool = False, min_weeks: int = 12
) -> DataFrame:
    """Peaks and troughs of each series, at least ``distance`` weeks apart.

    ``above_mean`` keeps peaks at or above the mean of the series and troughs at or below it.
    The pruning is greedy over one series, so it runs per series in pandas.
    """
    fields = [s.schema[k] for k in by] + [s.schema[week]]
    out = T.StructType(
        [*fields, T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType())]
    )

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(week).reset_index(drop=True)
        x = frame["value"].to_numpy(float)
        found = []
        for kind, signed in (("peak", x), ("trough", -x)):
            places = _local_maxima(signed)
            if above_mean:
                places = places[signed[places] >= signed.mean()]
            places = _spaced(places, signed[places], distance)
            found.append(frame.loc[places, [*by, week, "value"]].assign(pos=places, kind=kind))
        return pd.concat(found)[[f.name for f in out]]

    wanted = s.where((F.col("n") >= min_weeks) & F.col("value").isNotNull())
    data = wanted.select(*by, week, F.col("value").cast("double").alias("value"))
    return data.groupBy(*by).applyInPandas(find, out)


def cycle_length(turns: DataFrame, by: Keys = ()) -> DataFrame:
    """Peaks, troughs and the mean distance between peaks (NULL with fewer than two)."""
    peak = F.col("kind") == "peak"
    pos = F.when(peak, F.col("pos"))
    return turns.groupBy(*by).agg(
        F.count_if(peak).alias("peaks"),
        F.count_if(~peak).alias("troughs"),
        F.try_divide(F.max(pos) - F.min(pos), F.count(pos) - 1).alias("avg_cycle"),
    )


def lead_lag_corr(df: DataFrame, week: str, own: str, rival: str, by: Keys = (), min_changes: int = 10) -> DataFrame:
    """Correlation of weekly changes: same week, own one week ahead, rival one week ahead."""
    w = in_order(week, by)
    s = numbers_by(df, [*by, week], {"a": F.avg(own), "b": F.avg(rival)})
    d = s.select(*by, week, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in "ab"])
    d = d.withColumns({"a_before": F.lag("a").over(w), "b_before": F.lag("b").over(w)})
    out = d.groupBy(*by).agg(
        F.count("a").alias("own_changes"),
        F.count("b").alias("rival_changes"),
        correlation(F.col("a"), F.col("b")).alias("same_week"),
        correlation(F.col("b"), F.col("a_before")).alias("own_leads"),
        correlation(F.col("a"), F.col("b_before")).alias("rival_leads"),
    )
    return out.where((F.col("own_changes") > min_changes) & (F.col("rival_changes") > min_changes))
