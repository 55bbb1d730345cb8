"""Small shared shapes: keyed weekly series and both-ends rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import has_keys


def total(c: str) -> Column:
    """Sum that is 0, not NULL, when no value is present."""
    return F.coalesce(F.sum(c), F.lit(0))


def weekly(df: DataFrame, week: str, value: str, how: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, week): the series that all weekly analyses start from."""
    measure = {"sum": total(value), "mean": F.avg(value)}[how]
    return has_keys(df, *by, week).groupBy(*by, week).agg(measure.alias("value"))


def in_order(week: str, by: Sequence[str] = ()) -> WindowSpec:
    """Window over one series. Its length is the number of weeks, whatever the table size."""
    return Window.partitionBy(*by).orderBy(week)


def whole(by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by)


def both_ends(df: DataFrame, measure: str, keys: str | Sequence[str], low: int, high: int | None = None) -> DataFrame:
    """The lowest and highest rows by ``measure`` (NULL left out), marked in ``side``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    known = df.where(F.col(measure).isNotNull())
    bottom = known.orderBy(F.asc(measure), *keys).limit(low).withColumn("side", F.lit("lowest"))
    top = known.orderBy(F.desc(measure), *keys).limit(low if high is None else high)
    return bottom.unionByName(top.withColumn("side", F.lit("highest")))


def top_rows(df: DataFrame, measure: str, keys: str | Sequence[str], k: int, lowest: bool = False) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.asc(measure) if lowest else F.desc(measure)
    return df.where(F.col(measure).isNotNull()).orderBy(order, *keys).limit(k)
