"""Product catalog analysis. Inputs are frames from ``prepare.with_catalog_metrics``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import numbers_by
from ..functions.columns import has_keys
from ..functions.running import cumulative_share, quantile_row, quantiles_row
from ..session import materialize
from .quality import value_counts


def portfolio_overview(df: DataFrame) -> DataFrame:
    """SKUs, distinct UPCs, active and inactive products, as one row."""
    active = F.count_if(F.col("is_active"))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("skus"),
        F.count_distinct("upc").alias("distinct_upcs"),
        active.alias("active"),
        (rows - active).alias("inactive"),
        (F.try_divide(active, rows) * 100).alias("active_pct"),
    )


def status_mix(df: DataFrame) -> DataFrame:
    return value_counts(df, "item_status_code")


def source_countries(df: DataFrame, k: int = 5) -> DataFrame:
    return value_counts(df, "country_name").limit(k)


def hierarchy_cardinality(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct values of each hierarchy level that exists, numbered from the top."""
    present = [c for c in levels if c in df.columns]
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in present])
    tall = wide.unpivot([], present, "level", "categories")
    place = F.array_position(F.array(*[F.lit(c) for c in levels]), F.col("level"))
    return tall.withColumn("depth", place.cast("int"))


def top_share(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` largest categories, their share, and the share of all ``k`` together."""
    top = value_counts(df, column).limit(k)
    return top.withColumn("top_pct", F.sum("pct").over(Window.partitionBy()))


def vendor_brand_landscape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("vendor_name").alias("vendors"),
        F.count_distinct("brand_name").alias("brands"),
        F.count_distinct("brand_type").alias("brand_types"),
    )


def department_analysis(df: DataFrame, dept: str = "dept_desc", price: str = "base_unit_retail_amt") -> DataFrame:
    return numbers_by(
        df,
        [dept],
        {
            "products": F.count("item_nbr"),
            "avg_price": F.avg(price),
            "std_price": F.stddev_samp(price),
            "avg_margin_pct": F.avg("margin_percent"),
            "active": F.count_if("is_active"),
        },
        {"median_price": price},
    )


def category_breadth(df: DataFrame, dept: str = "dept_desc", category: str = "dept_category_desc") -> DataFrame:
    """Categories per department; high above the upper quartile, low below the lower one."""
    breadth = has_keys(df, dept).groupBy(dept).agg(F.count_distinct(category).alias("categories"))
    q = quantile_row(breadth, "categories", [0.25, 0.75])
    level = F.when(F.col("categories") > q["q75"], "high").when(F.col("categories") < q["q25"], "low")
    return breadth.withColumn("complexity", level)


def concentration(totals: DataFrame, entity: str, measure: str, threshold: float = 80.0, inclusive: bool = False) -> DataFrame:
    """Entities by descending measure with cumulative percent and membership of the top group.

    ``inclusive`` also counts the entity whose share crosses the threshold.
    """
    shares = cumulative_share(totals, entity, measure)
    reached = F.col("cum_pct")
    if inclusive:
        reached = F.try_divide(F.col("cum_value") - F.col(measure), F.col("total_value")) * 100
    return shares.select(entity, measure, "position", "cum_pct", (reached <= threshold).alias("in_top"))


def concentration_summary(flagged: DataFrame) -> DataFrame:
    rows, top = F.count(F.lit(1)), F.count_if("in_top")
    return flagged.agg(
        rows.alias("entities"),
        top.alias("top_entities"),
        (F.try_divide(top, rows) * 100).alias("top_entities_pct"),
        F.max(F.when(F.col("in_top"), F.col("cum_pct"))).alias("top_share_pct"),
    )


def sku_density(df: DataFrame, dept: str = "dept_desc") -> DataFrame:
    """Categories, subcategories and SKUs per department; flag ratios above the upper quartile."""
    per = (
        has_keys(df, dept)
        .groupBy(dept)
        .agg(
            F.count_distinct("dept_category_desc").alias("categories"),
            F.count_distinct("dept_subcatg_desc").alias("subcategories"),
            F.count("item_nbr").alias("skus"),
        )
        .withColumns(
            {
                "skus_per_category": F.try_divide("skus", "categories"),
                "skus_per_subcategory": F.try_divide("skus", "subcategories"),
            }
        )
    )
    q = quantile_row(per, "skus_per_category", [0.75])
    return per.withColumn("proliferation", F.coalesce(F.col("skus_per_category") > q["q75"], F.lit(False)))


# The four labels of the volume x margin quadrants.
QUADRANTS = (
    "High Volume, High Margin",
    "High Volume, Low Margin",
    "Low Volume, High Margin",
    "Low Volume, Low Margin",
)


def strategic_class(df: DataFrame, dept: str = "dept_desc", price: str = "base_unit_retail_amt") -> DataFrame:
    """Departments by volume and margin against the medians (means rounded to cents first)."""
    per = (
        has_keys(df, dept)
        .groupBy(dept)
        .agg(
            F.count("item_nbr").alias("products"),
            F.round(F.avg(price), 2).alias("avg_price"),
            F.round(F.avg("margin_percent"), 2).alias("avg_margin"),
        )
    )
    per = materialize(per)  # one row per department
    median = quantiles_row(per, ["products", "avg_margin"])
    volume, margin = F.col("products") > median["products"], F.col("avg_margin") > median["avg_margin"]
    both, large, rich, neither = QUADRANTS
    label = F.when(volume & margin, both).when(volume, large).when(margin, rich).otherwise(neither)
    return per.withColumn("strategy", label)


def class_examples(classified: DataFrame, label: str, key: str, n: int = 3) -> DataFrame:
    """The first ``n`` keys of each class; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy(label).orderBy(key)
    return classified.withColumn("example", F.row_number().over(order)).where(F.col("example") <= n)


def brand_type_comparison(df: DataFrame, price: str = "base_unit_retail_amt") -> DataFrame:
    return numbers_by(
        df,
        ["brand_type"],
        {
            "products": F.count_distinct("item_nbr"),
            "avg_price": F.avg(price),
            "avg_margin_pct": F.avg("margin_percent"),
        },
    )


def top_brands(df: DataFrame, by: str = "products", k: int = 5, price: str = "base_unit_retail_amt") -> DataFrame:
    """Top brands by ``products`` (distinct items), ``avg_price`` or ``avg_margin_pct``."""
    measure = {
        "products": F.count_distinct("item_nbr"),
        "avg_price": F.avg(price),
        "avg_margin_pct": F.avg("margin_percent"),
    }[by]
    per = numbers_by(df, ["brand_name"], {by: measure})
    return per.where(F.col(by).isNotNull()).orderBy(F.desc(by), "brand_name").limit(k)


def _largest_vendors(df: DataFrame, k: int) -> DataFrame:
    per = numbers_by(df, ["vendor_name"], {"products": F.count_distinct("item_nbr"), "avg_margin_pct": F.avg("margin_percent")})
    return per.orderBy(F.desc("products"), "vendor_name").limit(k)


def vendor_profitability(df: DataFrame, k: int = 10) -> DataFrame:
    """Margin of the ``k`` vendors with the most distinct items, best margin first."""
    return _largest_vendors(df, k).orderBy(F.desc("avg_margin_pct"), "vendor_name")


def vendor_brand_map(df: DataFrame, k: int = 10) -> DataFrame:
    """Items per vendor and brand type for the largest vendors, one row for each pair that occurs."""
    largest = _largest_vendors(df, k).select("vendor_name")
    counted = df.where(F.col("brand_type").isNotNull()).groupBy("vendor_name", "brand_type").agg(F.count(F.lit(1)).alias("items"))
    return counted.join(largest, "vendor_name", "left_semi")
