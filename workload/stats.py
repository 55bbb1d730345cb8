"""Significance, correlation and component queries."""

from pyspark.sql import functions as F

from aislemetrics.operators import prepare, stats
from workload.competitive import corr_sql
from workload.registry import query

INSTORE = ["base_unit_retail_amt", "comp_reg", "comp_live", "reg_price_gap"]
PRICES = ["live_price_amt", "defined_reg_price_amt", "competitor_price_amt", "gap_reg_live"]


def m(v):
    return prepare.with_price_metrics(v.store_price)


def anova_sql(value, group, table):
    return (
        f"with k as (select {group} as g, {value} as x from {table} where {group} is not null and {value} is not null), "
        "p as (select g, count(*) as n, avg(x) as m, var_samp(x) as v from k group by 1) "
        "select count(*) as groups, sum(n) as n, (sum(n * pow(m - (select avg(x) from k), 2)) / (count(*) - 1)) / "
        "(sum((n - 1) * coalesce(v, 0)) / (sum(n) - count(*))) as f from p having count(*) > 1"
    )


for _name, _value, _group, _table in (
    ("anova_price_by_region", "live_price_amt", "region_nm", "store_price"),
    ("anova_price_by_province", "live_price_amt", "prov_cd", "store_price"),
    ("anova_price_by_brand_type", "base_unit_retail_amt", "brand_type", "instore"),
):
    query(_name, "J120", anova_sql(_value, _group, _table), "n:i f:7")(
        lambda v, a=_value, g=_group, t=_table: stats.anova_oneway(getattr(v, t), a, g).select("groups", "n", "f")
    )
query("anova_with_p", "J120 J125")(lambda v: stats.anova_oneway(v.store_price, "live_price_amt", "region_nm"))


def ttest_sql(value, first, second, table, equal):
    moments = (
        f"select count({value}) filter ({first}) as n1, count({value}) filter ({second}) as n2, avg({value}) filter ({first}) as mean1, "
        f"avg({value}) filter ({second}) as mean2, var_samp({value}) filter ({first}) as v1, var_samp({value}) filter ({second}) as v2 from {table}"
    )
    if equal:
        error, df = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)", "(n1 + n2 - 2)::double"
    else:
        error = "(v1 / n1 + v2 / n2)"
        df = "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"
    return (
        f"select n1, n2, mean1, mean2, (mean1 - mean2) / sqrt({error}) as t, {df} as df from ({moments}) where n1 > 10 and n2 > 10"
    )


_PROMO = ("on_promotion", "not on_promotion", "price_m")
for _name, _equal in (("ttest_gap_by_promotion", True), ("welch_gap_by_promotion", False)):
    query(_name, "J121", ttest_sql("gap_reg_live", *_PROMO, _equal), "mean1,mean2,t:7 df:4")(
        lambda v, e=_equal: stats.ttest(m(v), "gap_reg_live", F.col("on_promotion"), ~F.col("on_promotion"), e).drop(
            "p_value", "significant"
        )
    )
query("ttest_price_by_brand", "J121", ttest_sql("base_unit_retail_amt", "brand_type = 'PL'", "brand_type = 'NB'", "instore", True), "mean1,mean2,t:7 df:4")(
    lambda v: stats.ttest(
        v.instore, "base_unit_retail_amt", F.col("brand_type") == "PL", F.col("brand_type") == "NB"
    ).drop("p_value", "significant")
)
query("ttest_with_p", "J121 J125")(
    lambda v: stats.ttest(v.instore, "base_unit_retail_amt", F.col("brand_type") == "PL", F.col("brand_type") == "NB")
)


def normality_sql(columns, table):
    base = " union all ".join(
        f"select '{c}' as \"column\", count({c})::double as n, "
        f"(select avg(pow(x.{c} - u.m, 3)) / pow(avg(pow(x.{c} - u.m, 2)), 1.5) from {table} x, (select avg({c}) as m from {table}) u) as s, "
        f"kurtosis_pop({c}) as k from {table}"
        for c in columns
    )
    return f"""
with b as ({base}),
c as (select *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y0,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as b2,
  3 * (n - 1) / (n + 1) as e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) as v,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as rb from b),
d as (select *, case when y0 = 0 then 1 else y0 end as y, sqrt(2 * (b2 - 1)) - 1 as w2, (k + 3 - e) / sqrt(v) as x,
  6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) as a from c),
f as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, 1 + x * sqrt(2 / (a - 4)) as den from d),
g as (select *, (1 - 2 / (9 * a) - sign(den) * cbrt((1 - 2 / a) / abs(den))) / sqrt(2 / (9 * a)) as z2 from f)
select "column", n::bigint as n, s as skewness, k as kurtosis, z1 * z1 + z2 * z2 as k2, exp(-(z1 * z1 + z2 * z2) / 2) as p_value,
  case when exp(-(z1 * z1 + z2 * z2) / 2) < 0.05 then 'No' else 'Possibly' end as normal from g where n >= 8"""


query("normality_test", "J122 D22", normality_sql(["base_unit_retail_amt", "reg_price_gap", "comp_reg"], "instore"), "skewness,kurtosis,p_value:7 k2:4")(
    lambda v: stats.normality_test(v.instore, ["base_unit_retail_amt", "reg_price_gap", "comp_reg"])
)


def matrix_sql(columns, table, complete=False):
    where = " and ".join(f"{c} is not null" for c in columns) if complete else "true"
    return " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {corr_sql(a, b)} as r from {table} where {where}"
        for a in columns
        for b in columns
    )


query("correlation_matrix", "J123 D23", matrix_sql(INSTORE, "instore"), "r:8")(
    lambda v: stats.correlation_matrix(v.instore, INSTORE)
)
query("correlation_matrix_complete", "J123 B34", matrix_sql(PRICES, "price_m", True), "r:8")(
    lambda v: stats.correlation_matrix(m(v), PRICES, complete=True)
)


def strong_sql(columns, table, limit, complete):
    order = " ".join(f"when '{c}' then {i}" for i, c in enumerate(columns))
    return (
        f"select * from ({matrix_sql(columns, table, complete)}) where abs(r) > {limit} and "
        f"case column_a {order} end < case column_b {order} end"
    )


query("strong_correlations_0_5", "J124", strong_sql(INSTORE, "instore", 0.5, False), "r:8")(
    lambda v: stats.strong_correlations(v.instore, INSTORE, 0.5)
)
query("strong_correlations_0_7", "J124", strong_sql(PRICES, "price_m", 0.7, True), "r:8")(
    lambda v: stats.strong_correlations(m(v), PRICES, 0.7, complete=True)
)
query(
    "pca_explained_pair",
    "J126",
    # two standardised columns have the components (1 + |r|) / 2 and (1 - |r|) / 2
    "with c as (select abs(corr(base_unit_retail_amt, comp_live)) as r from instore where base_unit_retail_amt is not null and comp_live is not null) "
    "select 1 as component, (1 + r) / 2 as explained, (1 + r) / 2 as cumulative from c union all select 2, (1 - r) / 2, 1.0 from c",
    "explained,cumulative:8",
)(lambda v: stats.pca_explained(v.instore, ["base_unit_retail_amt", "comp_live"], min_columns=2))
query("pca_explained", "J126")(lambda v: stats.pca_explained(v.instore, INSTORE))
