"""Aggregate helpers: correlation, variation, modal pair, extremes, describe."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import has_keys, ratio
from .running import quantiles


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side.

    ``corr`` raises on constants under ANSI rules, hence the guarded quotient.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def variation(x: str) -> Column:
    """Coefficient of variation (sample deviation over mean); NULL for one row or mean 0."""
    return ratio(F.stddev_samp(x), F.avg(x))


def count_true(condition: Column) -> Column:
    return F.count_if(condition)


def key_of_max(key: str, value: str) -> Column:
    """Key at the highest value; the smallest key on a tie."""
    return F.min_by(F.col(key), F.struct(-F.col(value), F.col(key)))


def key_of_min(key: str, value: str) -> Column:
    """Key at the lowest value; the smallest key on a tie."""
    return F.min_by(F.col(key), F.struct(F.col(value), F.col(key)))


def tall_moments(df: DataFrame, columns: Sequence[str], moments: dict[str, Callable]) -> DataFrame:
    """One row per column with its moments: one aggregation of the rows, then rows from its one row.

    ``moments`` must have ``n``; a column without values gives no row.
    """
    wide = df.agg(*[f(c).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in moments.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in moments]) for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows))).where("n > 0")


def describe(df: DataFrame, columns: Sequence[str], with_quartiles: bool = True) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max of its non-null values."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stats = tall_moments(data, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    if not with_quartiles:
        return stats
    long = data.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    return stats.join(quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], groups=len(columns)), "column")


def numbers_by(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], medians: dict[str, str] | None = None) -> DataFrame:
    """Aggregate per key (NULL keys dropped); ``medians`` maps output names to columns."""
    df = has_keys(df, *keys)
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    for name, column in (medians or {}).items():
        out = out.join(quantiles(df, column, [0.5], [name], keys), list(keys), "left")
    return out
