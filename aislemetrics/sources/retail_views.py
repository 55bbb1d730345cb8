"""Retail-shaped views over the benchmark star schema.

Each view is one SELECT that Spark and DuckDB both run; ``{wk}`` stands for the ISO week code and
``{name}`` for a table. Three views need generated rows and have one text per engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region", "nation", "supplier", "part", "lineitem", "events")
_WEEK = {
    "spark": "cast(extract(YEAROFWEEK from l_shipdate) * 100 + extract(WEEK from l_shipdate) as int)",
    "duckdb": "cast(isoyear(l_shipdate) * 100 + week(l_shipdate) as int)",
}
_GEO = (
    "join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey "
    "join {region} on n_regionkey = r_regionkey"
)
_FACTOR = "(90e-2 + 1e-2 * ((l_partkey * 7 + l_suppkey * 13) % 21))"
_RETAIL = (
    "case when p_partkey % 50 = 0 then 0e0 when p_partkey % 53 = 0 then null "
    "else cast(p_partkey * 37 % 6000 as double) / 1e2 end"
)
_BRAND_TYPE = "case when {k} % 10 = 0 then null when {k} % 4 = 1 then 'PL' when {k} % 31 = 0 then 'XX' else 'NB' end"
_COMP_REG = (
    "case when l_partkey % 23 = 0 then null else "
    f"l_extendedprice / l_quantity / (1e0 - l_discount) * {_FACTOR} end"
)

_COMMON = {
    "catalog": f"""
select p_partkey as item_nbr, p_partkey + 1000000 as old_nbr,
  lpad(cast(p_partkey as string), 12, '0') as upc,
  p_partkey % 2 as sbu_nbr, case when p_partkey % 2 = 0 then 'FOOD' else 'GENERAL' end as sbu_desc,
  ascii(p_type) as dept_nbr, p_type as dept_desc,
  cast(replace(p_brand, 'Brand#', '') as int) as dept_category_nbr, p_brand as dept_category_desc,
  p_name as dept_subcatg_desc, p_partkey % 200 as hg_iv_id,
  'GC ' || cast(p_partkey % 200 as string) as var_long_desc, p_brand as brand_name,
  {_BRAND_TYPE.replace('{k}', 'p_partkey')} as brand_type,
  'VENDOR_' || cast(p_partkey % 17 as string) as vendor_name,
  'COUNTRY_' || cast(p_partkey % 7 as string) as country_name,
  case when p_partkey % 5 = 0 then 'D' else 'A' end as item_status_code,
  {_RETAIL} as base_unit_retail_amt,
  ({_RETAIL}) * (5e-1 + 1e-2 * (p_partkey % 60)) as cost
from {{part}}""",
    "weekly_sales": """
select l_suppkey as store_nbr, l_partkey as item_nbr, lpad(cast(l_partkey as string), 12, '0') as upc_nbr,
  {wk} as wm_yr_wk_nbr,
  case when (l_partkey * 3 + l_suppkey) % 29 = 0 then 0e0 else l_extendedprice end as wkly_sales_amt,
  l_quantity as wkly_qty,
  case when (l_partkey + l_suppkey * 3) % 17 = 0 then 0 else (l_partkey * 31 + l_suppkey * 17) % 120 end as onhand_invt_qty,
  (l_partkey * 11 + l_suppkey * 5) % 40 as in_trnst_invt_qty
from {lineitem}""",
    "store_price": f"""
select l_suppkey as store_nbr, n_name as prov_cd, r_name as region_nm, l_partkey as item_nbr,
  {{wk}} - 190000 as wm_wk_nbr, cast(l_shipdate as date) as price_date,
  l_extendedprice / l_quantity as live_price_amt,
  l_extendedprice / l_quantity / (1e0 - l_discount) as defined_reg_price_amt,
  l_extendedprice / l_quantity * {_FACTOR} as competitor_price_amt,
  case when l_discount >= 8e-2 then 1 when l_discount = 0e0 then null else 0 end as multi_save_ind
from {{lineitem}} {_GEO}""",
    "instore": f"""
select l_suppkey as hg_store_id, r_name as hg_region, {{wk}} as wm_week, l_partkey + 1000000 as item_nbr,
  lpad(cast(l_partkey as string), 12, '0') as upc_nbr,
  {_BRAND_TYPE.replace('{k}', 'l_partkey')} as brand_type,
  'BANNER_' || cast(l_linenumber % 5 as string) as banner_name,
  l_extendedprice / l_quantity as base_unit_retail_amt,
  {_COMP_REG} as comp_reg,
  case when l_partkey % 19 = 0 then null else l_extendedprice / l_quantity * {_FACTOR} end as comp_live,
  case when l_partkey % 11 = 0 then 2e0 else 0e0 end as equalization_factor,
  l_extendedprice / l_quantity - ({_COMP_REG}) as reg_price_gap,
  case when {_FACTOR} > 1.005e0 then 'Y' else 'N' end as item_win,
  case when {_FACTOR} between 0.995e0 and 1.005e0 then 'Y' else 'N' end as item_draw,
  case when {_FACTOR} < 0.995e0 then 'Y' else 'N' end as item_loss
from {{lineitem}} {_GEO}""",
    "store_dim": """
select s_suppkey as store_nbr, case when s_suppkey % 25 = 0 then null else r_name end as hg_region
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "group_metrics": f"""
select {{wk}} - 190000 as promo_hg_yr_wk, r_name as region, l_partkey % 200 as group_code_nbr,
  l_quantity as total_units, l_extendedprice as total_sales, l_quantity * 8e-1 as base_units,
  l_linenumber = 1 as on_flyer, l_linenumber = 2 as on_cpp,
  case when l_discount >= 8e-2 then 'TPR' else 'EDLP' end as price_mechanic
from {{lineitem}} {_GEO}""",
    "edlp_actioned": """
select g as group_code, cast(date '2000-01-01' as date) as effective_date
from (select distinct p_partkey % 200 as g from {part}) x where g % 4 = 0""",
    "events": "select event_id, ts, user_id, event_type, value, props from {events}",
}


def _measure(expr: str, name: str) -> str:
    text = "cast(cast(floor({}) as bigint) as string) as {}"
    cells = [(expr, name), (expr + " * 9e-1", name + "_ya")]
    out = []
    for e, n in cells:
        body = text.format(e, n)
        if n == "sales":
            body = f"case when l_partkey % 70 = 0 then 'n/a' else cast(cast(floor({e}) as bigint) as string) end as sales"
        out.append(body)
    return ", ".join(out)


_MARKET = (
    "select {wk} - 190000 as promo_yr_wk, lower(r_name) as region, r_name || ' ' || lv as market_description, "
    "pd as period_description, '000' || cast(l_partkey as string) || 'BP1' as upc, "
    + ", ".join(
        [
            _measure("l_extendedprice * lm * pm", "sales"),
            _measure("l_quantity * lm * pm", "units"),
            _measure("l_extendedprice * l_discount * lm * pm", "promo_sales"),
            _measure("l_quantity * l_discount * lm * pm", "promo_units"),
        ]
    )
    + " from {lineitem} "
    + _GEO
)
_LEVELS = (("ALL CHANNELS", "5e0"), ("GB +DR +MM", "3e0"), ("HG_MART", "1e0"), ("CALGARY", "1e0"))
_PERIODS = (("1 w/e", "1e0"), ("4 w/e", "4e0"), ("12 w/e", "12e0"), ("52 w/e", "52e0"))


def _spark_rows(rows, a, b):
    return "array(" + ", ".join(f"named_struct('{a}', '{x}', '{b}', {y})" for x, y in rows) + ")"


def _duck_rows(rows, a, b):
    return "(" + " union all ".join(f"select '{x}' as {a}, {y} as {b}" for x, y in rows) + ")"


_SPARK = {
    **_COMMON,
    "calendar_dim": """
select cast(d as date) as cal_dt,
  cast(extract(YEAROFWEEK from d) * 100 + extract(WEEK from d) as int) as hg_yr_wk_nbr
from (select explode(sequence(cast(date_trunc('YEAR', min(l_shipdate)) as date),
  date_sub(cast(date_trunc('YEAR', max(l_shipdate)) + interval 1 year as date), 1))) as d from {lineitem})""",
    "market_source": _MARKET
    + f" lateral view inline({_spark_rows(_LEVELS, 'lv', 'lm')}) lv_rows as lv, lm"
    + f" lateral view inline({_spark_rows(_PERIODS, 'pd', 'pm')}) pd_rows as pd, pm",
    "upc_map": """
select r_name as region, cast(p_partkey as string) as market_upc, cast(p_partkey + d as string) as own_upc
from (select p_partkey, d, explode(sequence(0, 4)) as rk
      from (select p_partkey, explode(case when p_partkey % 20 = 0 then array(0, 10) else array(0) end) as d
            from {part})) x join {region} on rk = r_regionkey""",
}
_DUCKDB = {
    **_COMMON,
    "calendar_dim": """
select cast(d as date) as cal_dt, cast(isoyear(d) * 100 + week(d) as int) as hg_yr_wk_nbr
from (select unnest(generate_series(date_trunc('year', min(l_shipdate)),
  date_trunc('year', max(l_shipdate)) + interval 1 year - interval 1 day, interval 1 day)) as d from {lineitem}) x""",
    "market_source": _MARKET
    + f" cross join {_duck_rows(_LEVELS, 'lv', 'lm')} l cross join {_duck_rows(_PERIODS, 'pd', 'pm')} p",
    "upc_map": """
select r_name as region, cast(p_partkey as string) as market_upc, cast(p_partkey + d as string) as own_upc
from {part} cross join {region} cross join (select 0 as d union all select 10) x
where d = 0 or p_partkey % 20 = 0""",
}


def _fill(text: str, engine: str, tables: dict[str, str]) -> str:
    text = text.replace("{wk}", _WEEK[engine])
    for name in _TABLES:
        text = text.replace("{" + name + "}", tables[name])
    return text


def duckdb_view(name: str) -> str:
    """The view as SQL over the registered tables."""
    return _fill(_DUCKDB[name], "duckdb", {t: t for t in _TABLES})


VIEW_NAMES = tuple(_DUCKDB)


class RetailViews:
    """The views as lazy DataFrames over ``<folder>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def _view(self, name: str) -> DataFrame:
        text = _fill(_SPARK[name], "spark", {t: "{" + t + "}" for t in _TABLES})
        used = {t: self.table(t) for t in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **used)

    catalog = cached_property(lambda self: self._view("catalog"))
    weekly_sales = cached_property(lambda self: self._view("weekly_sales"))
    store_price = cached_property(lambda self: self._view("store_price"))
    instore = cached_property(lambda self: self._view("instore"))
    calendar_dim = cached_property(lambda self: self._view("calendar_dim"))
    store_dim = cached_property(lambda self: self._view("store_dim"))
    market_source = cached_property(lambda self: self._view("market_source"))
    upc_map = cached_property(lambda self: self._view("upc_map"))
    group_metrics = cached_property(lambda self: self._view("group_metrics"))
    edlp_actioned = cached_property(lambda self: self._view("edlp_actioned"))
    events = cached_property(lambda self: self._view("events"))

