"""Profiling and data-quality checks. Each is one pass over the data, whatever the column count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import describe
from ..functions.columns import has_keys, numeric_columns, require, text_columns
from ..functions.running import quantiles
from ..session import scalar_row


def _tall(df: DataFrame, columns: Sequence[str], cell, out: str, ids: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate per column in a single pass, turned into one row per column."""
    ids = ids or {}
    wide = df.agg(*[c.alias(n) for n, c in ids.items()], *[cell(c).alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), "column", out)


def missing_summary(df: DataFrame, only_missing: bool = False, top: int | None = None) -> DataFrame:
    """Missing count and percent per column, most first."""
    tall = _tall(df, df.columns, lambda c: F.count_if(F.col(c).isNull()), "missing_count", {"_rows": F.count(F.lit(1))})
    out = tall.select(
        "column",
        "missing_count",
        (F.try_divide(F.col("missing_count"), F.col("_rows")) * 100).alias("missing_pct"),
    )
    out = out.where("missing_count > 0") if only_missing else out
    out = out.orderBy(F.desc("missing_count"), "column")
    return out.limit(top) if top else out


def field_completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Percent of rows with a value, for the listed fields that exist."""
    present = [c for c in fields if c in df.columns]
    return _tall(df, present, lambda c: F.avg(F.col(c).isNotNull().cast("double")) * 100, "complete_pct")


def table_completeness(df: DataFrame) -> DataFrame:
    """Percent of all cells that hold a value, as one row."""
    filled = sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0]))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg((F.try_divide(filled, cells) * 100).alias("completeness_pct"))


def duplicate_report(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows (or keys) and duplicates. NULLs count as equal."""
    rows = F.count(F.lit(1))
    distinct = F.count_distinct(F.struct(*(keys or df.columns)))
    return df.agg(rows.alias("rows"), distinct.alias("distinct_rows"), (rows - distinct).alias("duplicates"))


def invalid_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative and zero values per column."""
    wide = df.agg(
        *[
            F.struct(F.count_if(F.col(c) < 0).alias("negatives"), F.count_if(F.col(c) == 0).alias("zeros")).alias(c)
            for c in columns
        ]
    )
    return wide.unpivot([], list(columns), "column", "n").select("column", "n.negatives", "n.zeros")


def count_where(df: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def extreme_margin_count(df: DataFrame, margin: str = "margin_percent", limit: float = 100.0) -> DataFrame:
    return count_where(df, (F.col(margin) < -limit) | (F.col(margin) > limit), "extreme_margins")


def sales_without_inventory(
    df: DataFrame, sales: str = "wkly_sales_amt", onhand: str = "onhand_invt_qty"
) -> DataFrame:
    return count_where(df, (F.col(sales) > 0) & (F.col(onhand) == 0), "sales_without_inventory")


def sigma_outliers(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """Values more than ``k`` sample deviations from the mean, per column, where there are any."""
    moments = scalar_row(
        df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    )
    tall = _tall(
        df,
        columns,
        lambda c: F.count_if(F.abs(F.col(c) - moments[f"m_{c}"]) > moments[f"s_{c}"] * k),
        "outliers",
    )
    return tall.where("outliers > 0")


def dataset_overview(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Rows, columns, distinct values of each key, first and last period."""
    return require(df, *keys, period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys],
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )


def distinct_estimates(df: DataFrame, columns: Sequence[str], error: float = 0.02) -> DataFrame:
    """Approximate distinct values per column in one pass with fixed-size sketches."""
    return _tall(df, columns, lambda c: F.approx_count_distinct(c, error), "approx_distinct")


def type_counts(df: DataFrame) -> DataFrame:
    """Columns per data type."""
    types = [(f.name, f.dataType.simpleString()) for f in df.schema]
    frame = df.sparkSession.createDataFrame(types, "column string, type string")
    return frame.groupBy("type").agg(F.count("column").alias("columns"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return describe(df, list(columns or numeric_columns(df)))


def value_counts(df: DataFrame, column: str, share: bool = True) -> DataFrame:
    """Rows per non-null value, with their share of all rows in percent."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if share:  # the null group counts as rows; the exchange of the groups serves both
        rows = counted.agg(F.sum("n").alias("rows")).scalar()
        counted = counted.withColumn("pct", F.try_divide(F.col("n"), rows) * 100)
    counted = counted.where(F.col(column).isNotNull())
    return counted.orderBy(F.desc("n"), column)


def category_top(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each text column."""
    columns = list(columns or text_columns(df))
    counted = (
        df.select(*columns)
        .unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; bins without rows are left out."""
    ends = scalar_row(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    width = (ends["hi"] - ends["lo"]) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(column) - ends["lo"], width)), F.lit(0))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", "n", (ends["lo"] + F.col("bin") * width).alias("from_value"))
    )


def box_stats(df: DataFrame, group: str, column: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last values within ``reach`` quartile ranges) and outliers per group."""
    quarts = quantiles(df, column, [0.25, 0.5, 0.75], ["q25", "median", "q75"], [group])
    low = F.col("q25") - reach * (F.col("q75") - F.col("q25"))
    high = F.col("q75") + reach * (F.col("q75") - F.col("q25"))
    value = F.col(column)
    inside = (value >= low) & (value <= high)
    # counted by value first: ends and outliers follow from the few values of a group
    counts = has_keys(df, group).where(value.isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counts.join(quarts, group)
        .groupBy(group)
        .agg(
            F.min(value).alias("min"),
            F.first("q25").alias("q25"),
            F.first("median").alias("median"),
            F.first("q75").alias("q75"),
            F.max(value).alias("max"),
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
    )


def records_per_key(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The ``k`` keys with the most rows."""
    return value_counts(df, key, share=False).limit(k)
