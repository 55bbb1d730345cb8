"""Column-level helpers: lenient casts, bins, guarded ratios, week codes, price endings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require(df: DataFrame, *names: str) -> DataFrame:
    """Raise when a needed column is absent, rather than skip the work silently."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} not in {df.columns}")
    return df


def has_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows with a NULL group key."""
    return require(df, *keys).dropna(subset=list(keys)) if keys else df


def coerce_numeric(df: DataFrame, names: Iterable[str], to: str = "double") -> DataFrame:
    """Cast the listed columns that exist; text that is no number becomes NULL."""
    return df.withColumns({n: F.col(n).try_cast(to) for n in names if n in df.columns})


def coerce_dates(df: DataFrame, names: Iterable[str], pattern: str | None = None) -> DataFrame:
    """Parse the listed columns that exist to timestamps; bad text becomes NULL."""

    def parse(n: str) -> Column:
        return F.try_to_timestamp(F.col(n), F.lit(pattern)) if pattern else F.col(n).try_cast("timestamp")

    return df.withColumns({n: parse(n) for n in names if n in df.columns})


def ratio(numerator: Column, denominator: Column, scale: float = 1.0, default: float | None = None) -> Column:
    """``numerator / denominator * scale``; a zero or missing denominator gives ``default``."""
    value = F.try_divide(numerator, denominator)
    value = value * F.lit(scale) if scale != 1.0 else value
    return value if default is None else F.coalesce(value, F.lit(default))


def bins(value: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; outside or NULL gives NULL.

    The last edge may be None for no upper bound. Edges may be columns.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    chosen = F.when(value <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chosen = chosen.when(value.isNotNull() if upper is None else value <= upper, F.lit(label))
    return chosen


def is_value(c: Column, value) -> Column:
    """Equality that is False, not NULL, for a missing value."""
    return F.coalesce(c == F.lit(value), F.lit(False))


def rate(condition: Column) -> Column:
    """Share of rows (0..1) for which a non-null condition holds."""
    return F.avg(condition.cast("double"))


# ---- week codes ------------------------------------------------------------

WEEK_SHIFT = 190000  # 1YYWW + 190000 = 20YYWW


def week_year(code: Column) -> Column:
    return F.floor(code / 100).cast("int")


def week_of_year(code: Column) -> Column:
    return (code % 100).cast("int")


def cycle_week(code: Column, one_based: bool = False) -> Column:
    """Position in a 52-week cycle: ``code % 52`` or ``(code - 1) % 52 + 1``."""
    return (F.pmod(code - 1, F.lit(52)) + 1 if one_based else F.pmod(code, F.lit(52))).cast("int")


def short_week_text(code: Column) -> Column:
    """YYYYWW to the text form '1YYWW'."""
    text = code.cast("string")
    return F.concat(F.lit("1"), F.substring(text, 3, 2), F.substring(text, 5, 2))


# ---- retail expressions ----------------------------------------------------

def clean_upc(upc: Column) -> Column:
    """Drop leading zeros and every BP-plus-digit marker. A blank inside becomes '0'."""
    bare = F.replace(F.ltrim(F.replace(upc, F.lit("0"), F.lit(" "))), F.lit(" "), F.lit("0"))
    return F.regexp_replace(bare, "BP[0-9]", "")


def price_cents(price: Column) -> Column:
    """The two digits after the decimal point, rounded first so that 4.35 gives 35."""
    return (F.round(price * 100).cast("long") % 100).cast("int")


def equalised(price: Column, factor: Column) -> Column:
    return F.when(factor > 0, price * factor).otherwise(price)


def modelled_competitor_price(price: Column, item: Column, store: Column) -> Column:
    """Stand-in competitor price: own price times a factor in [0.90, 1.10] fixed by the keys."""
    return price * (F.lit(0.9) + F.lit(0.01) * F.pmod(item * 7 + store * 13, F.lit(21)))


# The five stand-in categories, in the order of item number modulo 5.
CATEGORIES = ("Electronics", "Groceries", "Apparel", "Home Goods", "Toys")


def modelled_category(item: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.pmod(item, F.lit(5)).cast("int") + 1)


def market_name_excluded(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


# ---- column roles, from the schema only ------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def columns_named(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose lower-case name contains one of ``parts``."""
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def crosstab(long: DataFrame, row: str, column: str, value: str, fill=None, most: int = 200) -> DataFrame:
    """A matrix from (row, column, value): one column for every value of ``column`` in the data.

    The distinct values are read first; more than ``most`` raise, none is dropped.
    """
    found = [r[0] for r in long.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    wide = long.groupBy(row).pivot(column, sorted(found)).agg(F.first(value, ignorenulls=True)) if found else long.select(row).distinct()
    return wide if fill is None else wide.fillna(fill, [str(c) for c in sorted(found)])
