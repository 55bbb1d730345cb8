"""Registry of runnable queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.sources.retail_views import VIEW_NAMES, RetailViews, duckdb_view


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[RetailViews], DataFrame]
    sql: str | None
    rounds: tuple[tuple[str, str], ...]
    covers: str

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(RetailViews(spark, folder))
        return df.withColumns(
            {
                c: F.col(f"`{c}`").cast("long") if d == "i" else F.round(F.col(f"`{c}`"), int(d)) + F.lit(0.0)
                for c, d in self.rounds
            }
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        helpers = _named(self.sql, HELPERS)
        text = " ".join([self.sql, *[HELPERS[h] for h in helpers]])
        views = [f"{v} AS ({duckdb_view(v)})" for v in _named(text, VIEW_NAMES) if v != "events"]
        views += [f"{h} AS ({HELPERS[h]})" for h in helpers] + [f"answer AS ({self.sql})"]
        swaps = [
            f'CAST("{c}" AS BIGINT) AS "{c}"' if d == "i" else f'round("{c}", {d}) + 0e0 AS "{c}"'
            for c, d in self.rounds
        ]
        columns = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
        return f"WITH {', '.join(views)} SELECT {columns} FROM answer"


# SQL forms of the prepared frames, for the oracle texts.
HELPERS = {
    "catalog_m": """
select *, base_unit_retail_amt - cost as margin_dollars,
  coalesce((base_unit_retail_amt - cost) / nullif(base_unit_retail_amt, 0) * 100, 0) as margin_percent,
  case when coalesce(base_unit_retail_amt, 0) <= 0 then null when base_unit_retail_amt <= 5 then 'Value'
    when base_unit_retail_amt <= 15 then 'Mid-tier' when base_unit_retail_amt <= 50 then 'Premium'
    else 'Luxury' end as price_segment,
  coalesce(item_status_code = 'A', false) as is_active,
  coalesce(brand_type = 'NB', false) as is_national_brand, coalesce(brand_type = 'PL', false) as is_private_label
from catalog""",
    "sales_m": """
select *, wkly_sales_amt / (onhand_invt_qty + 0.01e0) as sales_to_inventory_ratio,
  onhand_invt_qty + in_trnst_invt_qty as total_inventory, wkly_sales_amt > 0 as has_sales,
  case when wkly_sales_amt <= 0 then null when wkly_sales_amt <= 1 then 'No Sales'
    when wkly_sales_amt <= 10 then 'Low Sales' when wkly_sales_amt <= 100 then 'Medium Sales'
    when wkly_sales_amt is not null then 'High Sales' end as sales_category,
  case when onhand_invt_qty <= 0 then null when onhand_invt_qty <= 1 then 'Out of Stock'
    when onhand_invt_qty <= 50 then 'Low Stock' when onhand_invt_qty <= 500 then 'Normal Stock'
    when onhand_invt_qty is not null then 'High Stock' end as inventory_status,
  cast(wm_yr_wk_nbr // 100 as int) as year, cast(wm_yr_wk_nbr % 100 as int) as week
from weekly_sales""",
    "price_m": """
select *, defined_reg_price_amt - live_price_amt as gap_reg_live,
  coalesce((defined_reg_price_amt - live_price_amt) / nullif(defined_reg_price_amt, 0) * 100, 0) as discount_pct,
  coalesce(multi_save_ind = 1, false) as on_promotion
from store_price""",
}


def _named(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, rounds: str = ""):
    """Register ``build(views) -> DataFrame``.

    ``rounds`` lists ``column:digits`` (decimal digits compared; sums in floating point depend on
    the order of addition) or ``column:i`` (compare as 64-bit integer).
    """
    pairs = []
    for item in rounds.split():
        names, digits = item.rsplit(":", 1)
        pairs += [(n.replace("~", " "), digits) for n in names.split(",")]

    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, sql, tuple(pairs), covers)
        return build

    return add
