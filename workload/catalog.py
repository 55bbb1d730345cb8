"""Product catalog queries."""

from pyspark.sql import functions as F

from aislemetrics.operators import catalog, prepare
from workload.registry import query

LEVELS = ["sbu_desc", "division_desc", "dept_desc", "dept_category_desc", "dept_subcatg_desc", "fineline_desc"]


def m(v):
    return prepare.with_catalog_metrics(v.catalog)


query(
    "portfolio_overview",
    "J20 B8",
    "select count(*) as skus, count(distinct upc) as distinct_upcs, count(*) filter (is_active) as active, "
    "count(*) - count(*) filter (is_active) as inactive, 100e0 * count(*) filter (is_active) / count(*) as active_pct from catalog_m",
    "active_pct:6",
)(lambda v: catalog.portfolio_overview(m(v)))


def _mix(column, limit=""):
    return (
        f"select {column}, count(*) as n, count(*) * 100e0 / (select count(*) from catalog_m) as pct from catalog_m "
        f"where {column} is not null group by 1 order by n desc, 1 {limit}"
    )


query("status_mix", "J20", _mix("item_status_code"), "pct:6")(lambda v: catalog.status_mix(m(v)))
query("source_countries", "J20", _mix("country_name", "limit 5"), "pct:6")(lambda v: catalog.source_countries(m(v)))
query(
    "hierarchy_cardinality",
    "J21",
    " union all ".join(
        f"select '{c}' as level, count(distinct {c}) as categories, {LEVELS.index(c) + 1} as depth from catalog"
        for c in LEVELS
        if c not in ("division_desc", "fineline_desc")
    ),
    "depth:i",
)(lambda v: catalog.hierarchy_cardinality(v.catalog, LEVELS))
query(
    "top_category_share",
    "J22",
    f"select *, sum(pct) over () as top_pct from ({_mix('dept_category_desc', 'limit 5')})",
    "pct,top_pct:6",
)(lambda v: catalog.top_share(m(v), "dept_category_desc", 5))
query(
    "vendor_brand_landscape",
    "J23",
    "select count(distinct vendor_name) as vendors, count(distinct brand_name) as brands, "
    "count(distinct brand_type) as brand_types from catalog",
)(lambda v: catalog.vendor_brand_landscape(v.catalog))
query("top_vendors_by_records", "J23", _mix("vendor_name", "limit 10"), "pct:6")(
    lambda v: catalog.value_counts(m(v), "vendor_name").limit(10)
)
query("top_brands_by_records", "J23", _mix("brand_name", "limit 10"), "pct:6")(
    lambda v: catalog.value_counts(m(v), "brand_name").limit(10)
)
query("brand_type_mix", "J23", _mix("brand_type"), "pct:6")(lambda v: catalog.value_counts(m(v), "brand_type"))
query("price_segment_distribution", "J24 B5", _mix("price_segment"), "pct:6")(
    lambda v: catalog.value_counts(m(v), "price_segment")
)
query(
    "department_analysis",
    "J25",
    "select dept_desc, count(item_nbr) as products, avg(base_unit_retail_amt) as avg_price, "
    "stddev_samp(base_unit_retail_amt) as std_price, avg(margin_percent) as avg_margin_pct, "
    "count(*) filter (is_active) as active, quantile_cont(base_unit_retail_amt, 0.5) as median_price "
    "from catalog_m where dept_desc is not null group by 1",
    "avg_price,std_price,avg_margin_pct,median_price:6",
)(lambda v: catalog.department_analysis(m(v)))
query(
    "category_breadth",
    "J26 D3 D15",
    "with b as (select dept_category_desc, count(distinct dept_subcatg_desc) as categories from catalog where dept_category_desc is not null group by 1) "
    "select *, case when categories > (select quantile_cont(categories, 0.75) from b) then 'high' "
    "when categories < (select quantile_cont(categories, 0.25) from b) then 'low' end as complexity from b",
)(lambda v: catalog.category_breadth(v.catalog, "dept_category_desc", "dept_subcatg_desc"))


def _brand_counts(v):
    return v.catalog.where("brand_name is not null").groupBy("brand_name").agg(F.count(F.lit(1)).alias("products"))


_SHARES = (
    "select brand_name, products, row_number() over o as position, "
    "100e0 * sum(products) over (o rows unbounded preceding) / sum(products) over () as cum_pct, "
    "100e0 * (sum(products) over (o rows unbounded preceding) - products) / sum(products) over () as before_pct "
    "from (select brand_name, count(*) as products from catalog where brand_name is not null group by 1) "
    "window o as (order by products desc, brand_name)"
)
query(
    "brand_concentration",
    "J27 E3",
    f"select brand_name, products, position, cum_pct, cum_pct <= 80 as in_top from ({_SHARES})",
    "cum_pct:6",
)(lambda v: catalog.concentration(_brand_counts(v), "brand_name", "products"))
query(
    "brand_concentration_inclusive",
    "J27",
    f"select count(*) as entities, count(*) filter (before_pct <= 80) as top_entities, "
    f"100e0 * count(*) filter (before_pct <= 80) / count(*) as top_entities_pct, "
    f"max(cum_pct) filter (before_pct <= 80) as top_share_pct from ({_SHARES})",
    "top_entities_pct,top_share_pct:6",
)(
    lambda v: catalog.concentration_summary(
        catalog.concentration(_brand_counts(v), "brand_name", "products", inclusive=True)
    )
)
query(
    "sku_density",
    "J28",
    "with d as (select dept_desc, count(distinct dept_category_desc) as categories, "
    "count(distinct dept_subcatg_desc) as subcategories, count(item_nbr) as skus from catalog where dept_desc is not null group by 1), "
    "r as (select *, skus / nullif(categories, 0) as skus_per_category, skus / nullif(subcategories, 0) as skus_per_subcategory from d) "
    "select *, coalesce(skus_per_category > (select quantile_cont(skus_per_category, 0.75) from r), false) as proliferation from r",
    "skus_per_category,skus_per_subcategory:6",
)(lambda v: catalog.sku_density(v.catalog))

_STRATEGY = (
    "with d as (select dept_category_desc, count(item_nbr) as products, round(avg(base_unit_retail_amt), 2) as avg_price, "
    "round(avg(margin_percent), 2) as avg_margin from catalog_m where dept_category_desc is not null group by 1), "
    "q as (select quantile_cont(products, 0.5) as p, quantile_cont(avg_margin, 0.5) as m from d) "
    "select d.*, case when products > p and avg_margin > m then 'High Volume, High Margin' "
    "when products > p then 'High Volume, Low Margin' when avg_margin > m then 'Low Volume, High Margin' "
    "else 'Low Volume, Low Margin' end as strategy from d, q"
)
query("strategic_class", "J29 I1", _STRATEGY, "avg_price,avg_margin:2")(
    lambda v: catalog.strategic_class(m(v), "dept_category_desc")
)
query(
    "strategic_class_summary",
    "J29",
    f"select strategy, count(*) as n, count(*) * 100e0 / sum(count(*)) over () as pct from ({_STRATEGY}) group by 1",
    "pct:6",
)(lambda v: catalog.value_counts(catalog.strategic_class(m(v), "dept_category_desc"), "strategy"))
query(
    "strategic_class_examples",
    "J29 F3",
    f"select * from (select *, row_number() over (partition by strategy order by dept_category_desc) as example from ({_STRATEGY})) where example <= 3",
    "avg_price,avg_margin:2",
)(lambda v: catalog.class_examples(catalog.strategic_class(m(v), "dept_category_desc"), "strategy", "dept_category_desc"))
query(
    "brand_type_comparison",
    "J30",
    "select brand_type, count(distinct item_nbr) as products, avg(base_unit_retail_amt) as avg_price, "
    "avg(margin_percent) as avg_margin_pct from catalog_m where brand_type is not null group by 1",
    "avg_price,avg_margin_pct:6",
)(lambda v: catalog.brand_type_comparison(m(v)))
for _by, _expr in {
    "products": "count(distinct item_nbr)",
    "avg_price": "avg(base_unit_retail_amt)",
    "avg_margin_pct": "avg(margin_percent)",
}.items():
    query(
        f"top_brands_{_by}",
        "J31 F2",
        f"select brand_name, {_expr} as {_by} from catalog_m where brand_name is not null group by 1 "
        f"order by {_by} desc, brand_name limit 5",
        "" if _by == "products" else f"{_by}:6",
    )(lambda v, by=_by: catalog.top_brands(m(v), by))

_VENDORS = (
    "select vendor_name, count(distinct item_nbr) as products, avg(margin_percent) as avg_margin_pct "
    "from catalog_m where vendor_name is not null group by 1 order by products desc, vendor_name limit 10"
)
query("vendor_profitability", "J32 C13", _VENDORS, "avg_margin_pct:6")(lambda v: catalog.vendor_profitability(m(v)))
query(
    "vendor_brand_map",
    "J33 D11 C13",
    "select vendor_name, brand_type, count(*) as items from catalog_m "
    f"where brand_type is not null and vendor_name in (select vendor_name from ({_VENDORS})) group by all",
)(lambda v: catalog.vendor_brand_map(m(v)))
