"""Derived columns that the analyses read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bins, is_value, modelled_category, modelled_competitor_price, price_cents, ratio
from ..functions.columns import require, week_of_year, week_year
from ..session import scalar_row

# Bin edges and labels (right-closed bins, None = no upper bound).
PRICE_SEGMENTS = ((0, 5, 15, 50, None), ("Value", "Mid-tier", "Premium", "Luxury"))
SALES_LEVELS = ((0, 1, 10, 100, None), ("No Sales", "Low Sales", "Medium Sales", "High Sales"))
STOCK_LEVELS = ((0, 1, 50, 500, None), ("Out of Stock", "Low Stock", "Normal Stock", "High Stock"))


def with_catalog_metrics(df: DataFrame, price: str = "base_unit_retail_amt", cost: str = "cost") -> DataFrame:
    """Margins (0 where undefined), price segment, status and brand flags."""
    require(df, price, cost, "item_status_code", "brand_type")
    margin = F.col(price) - F.col(cost)
    return df.withColumns(
        {
            "margin_dollars": margin,
            "margin_percent": ratio(margin, F.col(price), 100.0, default=0.0),
            "price_segment": bins(F.coalesce(F.col(price), F.lit(0.0)), *PRICE_SEGMENTS),
            "is_active": is_value(F.col("item_status_code"), "A"),
            "is_national_brand": is_value(F.col("brand_type"), "NB"),
            "is_private_label": is_value(F.col("brand_type"), "PL"),
        }
    )


def fill_unknown(df: DataFrame, levels: list[str]) -> DataFrame:
    """``<level>_clean`` with 'Unknown' for a missing value."""
    return df.withColumns(
        {f"{c}_clean": F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in levels if c in df.columns}
    )


def with_sales_metrics(
    df: DataFrame,
    sales: str = "wkly_sales_amt",
    onhand: str = "onhand_invt_qty",
    transit: str = "in_trnst_invt_qty",
    week: str = "wm_yr_wk_nbr",
) -> DataFrame:
    """Sales-to-inventory ratio, total inventory, sales and stock levels, year and week."""
    require(df, sales, onhand, transit, week)
    return df.withColumns(
        {
            "sales_to_inventory_ratio": F.col(sales) / (F.col(onhand) + F.lit(0.01)),
            "total_inventory": F.col(onhand) + F.col(transit),
            "has_sales": F.col(sales) > 0,
            "sales_category": bins(F.col(sales), *SALES_LEVELS),
            "inventory_status": bins(F.col(onhand), *STOCK_LEVELS),
            "year": week_year(F.col(week)),
            "week": week_of_year(F.col(week)),
        }
    )


def with_price_metrics(
    df: DataFrame,
    live: str = "live_price_amt",
    regular: str = "defined_reg_price_amt",
    promo_flag: str = "multi_save_ind",
) -> DataFrame:
    """Regular-minus-live gap, discount percent (0 where undefined), promotion flag."""
    require(df, live, regular, promo_flag)
    gap = F.col(regular) - F.col(live)
    return df.withColumns(
        {
            "gap_reg_live": gap,
            "discount_pct": ratio(gap, F.col(regular), 100.0, default=0.0),
            "on_promotion": is_value(F.col(promo_flag), 1),
        }
    )


def with_competitor_price(
    df: DataFrame, live: str = "live_price_amt", item: str = "item_nbr", store: str = "store_nbr"
) -> DataFrame:
    """Stand-in competitor price fixed by the keys, and the gap to it."""
    rival = modelled_competitor_price(F.col(live), F.col(item), F.col(store))
    return df.withColumns({"competitor_price": rival, "gap_live_comp": F.col(live) - rival})


def with_calendar_parts(df: DataFrame, day: str = "price_date", price: str = "live_price_amt") -> DataFrame:
    return df.withColumns(
        {
            "month": F.month(day),
            "day_name": F.date_format(day, "EEEE"),
            "price_cents": price_cents(F.col(price)),
        }
    )


def with_category(df: DataFrame, item: str = "item_nbr") -> DataFrame:
    return df.withColumn("product_category", modelled_category(F.col(item)))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 by its global range; NULL for a constant column."""
    bounds = scalar_row(
        df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    )
    return df.withColumns(
        {
            c: F.try_divide(F.col(c) - bounds[f"lo_{c}"], bounds[f"hi_{c}"] - bounds[f"lo_{c}"])
            for c in columns
        }
    )


def display_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select the mapped columns under their display names, in map order."""
    return df.select(*[F.col(c).alias(n) for c, n in names.items()])
