"""Store similarity and clustering queries."""

from pyspark.sql import functions as F

from aislemetrics.operators import cluster, network, prepare
from workload.registry import query

SALES = ("store_nbr", "wm_yr_wk_nbr", "wkly_sales_amt")
PRICE = ("store_nbr", "wm_wk_nbr", "live_price_amt")


def zero_sql(lag=0):
    """All ordered pairs with weeks missing as 0, over week positions."""
    return f"""
(with c as (select store_nbr as s, wm_yr_wk_nbr as w, avg(wkly_sales_amt) as x from weekly_sales group by 1, 2),
k as (select w, row_number() over (order by w) as p from (select distinct w from c)),
g as (select s.s, k.p, coalesce(c.x, 0) as x from (select distinct s from c) s cross join k left join c on c.s = s.s and c.w = k.w)
select a.s as store_a, b.s as store_b, covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) as r
from g a join g b on b.p = a.p + {lag} where a.s <> b.s group by 1, 2)"""


def pair_sql(lead=""):
    """All ordered pairs over shared weeks."""
    key, same = (f"{lead}, ", f"and a.{lead} = b.{lead}") if lead else ("", "")
    out = f"a.{lead}, " if lead else ""
    return f"""
(with c as (select {key}store_nbr as s, wm_wk_nbr as w, avg(live_price_amt) as x from store_price group by all)
select {out}a.s as store_a, b.s as store_b, covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) as r
from c a join c b on a.w = b.w {same} where a.s <> b.s group by all)"""


query("store_correlations_zero_filled", "J130 C15", f"select * from {zero_sql()} where store_a < store_b", "r:8")(
    lambda v: network.store_correlations(v.weekly_sales, *SALES)
)
query("store_correlations_shared_weeks", "J130", f"select * from {pair_sql()} where store_a < store_b", "r:8")(
    lambda v: network.store_correlations(v.store_price, *PRICE, fill_zero=False)
)
_STATS = "select (select count(distinct store_nbr) from {t}) as stores, avg(r) as mean_r, max(r) as max_r, min(r) as min_r from {p}"
query("network_stats_sales", "J131", _STATS.format(t="weekly_sales", p=zero_sql()), "mean_r,max_r,min_r:8")(
    lambda v: network.network_stats(v.weekly_sales, *SALES)
)
query("network_stats_price", "J131", _STATS.format(t="store_price", p=pair_sql()), "mean_r,max_r,min_r:8")(
    lambda v: network.network_stats(v.store_price, *PRICE, fill_zero=False)
)
_MEAN = "select store_a as store_nbr, (sum(r) + 1) / (count(r) + 1) as mean_r from {} group by 1"
query("connectedness", "J132", _MEAN.format(zero_sql()), "mean_r:8")(lambda v: network.connectedness(v.weekly_sales, *SALES))
query(
    "connectedness_extremes",
    "J132",
    f"with m as ({_MEAN.format(pair_sql())}) (select *, 'lowest' as side from m order by mean_r, store_nbr limit 1) "
    "union all (select *, 'highest' as side from m order by mean_r desc, store_nbr limit 1)",
    "mean_r:8",
)(lambda v: network.connectedness_extremes(network.connectedness(v.store_price, *PRICE, fill_zero=False), "store_nbr"))
query(
    "similar_pairs",
    "J133 C15",
    f"select * from {zero_sql()} where store_a < store_b and r > 0.05 order by store_a, store_b limit 10",
    "r:8",
)(lambda v: network.first_similar_pairs(network.similar_pairs(v.weekly_sales, *SALES, threshold=0.05)))
query(
    "similar_pairs_strong",
    "J133",
    f"select * from {zero_sql()} where store_a < store_b and r > 0.12",
    "r:8",
)(lambda v: network.similar_pairs(v.weekly_sales, *SALES, threshold=0.12))
query(
    "influence_scores",
    "J134",
    f"select store_a as store_nbr, count(*) filter (r > 0.05) as influences from {zero_sql(1)} group by 1",
)(lambda v: network.influence_scores(v.weekly_sales, *SALES, threshold=0.05))
query(
    "influence_scores_strong",
    "J134",
    f"select store_a as store_nbr, count(*) filter (r > 0.3) as influences from {zero_sql(1)} group by 1",
)(lambda v: network.influence_scores(v.weekly_sales, *SALES))
query(
    "price_coordination",
    "J135",
    f"select p.prov_cd, stores, mean_r from (select prov_cd, count(distinct store_nbr) as stores from store_price group by 1) p "
    f"join (select prov_cd, avg(r) as mean_r from {pair_sql('prov_cd')} group by 1) using (prov_cd) where stores > 1",
    "mean_r:8",
)(lambda v: network.price_coordination(v.store_price, "prov_cd", *PRICE))


def sales(v):
    return cluster.sales_features(prepare.with_sales_metrics(v.weekly_sales))


def prices(v):
    return cluster.price_features(prepare.with_price_metrics(v.store_price))


query(
    "store_sales_features",
    "J136",
    "select store_nbr, round(avg(wkly_sales_amt), 3) as avg_sales, round(stddev_samp(wkly_sales_amt), 3) as std_sales, "
    "round(sum(wkly_sales_amt), 3) as total_sales, round(avg(wkly_qty), 3) as avg_units, round(sum(wkly_qty), 3) as total_units, "
    "round(avg(onhand_invt_qty), 3) as avg_inventory, round(stddev_samp(onhand_invt_qty), 3) as std_inventory, "
    "round(avg(sales_to_inventory_ratio), 3) as avg_ratio from sales_m group by 1",
    "avg_sales,std_sales,total_sales,avg_units,total_units,avg_inventory,std_inventory,avg_ratio:3",
)(sales)
query(
    "store_cluster_totals",
    "J136",
    "select count(*) as stores, count(*) as ids, count(*) as assigned, least(5, count(*) // 3) as clusters from (select distinct store_nbr from weekly_sales) having count(*) > 10",
    "clusters:i",
)(
    lambda v: cluster.store_clusters(sales(v))
    .agg(
        F.count("*").alias("stores"),
        F.count_distinct("store_nbr").alias("ids"),
        F.count("cluster").alias("assigned"),
        F.count_distinct("cluster").alias("clusters"),
    )
    .where("stores > 0")
)


SALES_SET = {
    "avg_sales": "avg(wkly_sales_amt)", "std_sales": "stddev_samp(wkly_sales_amt)", "total_sales": "sum(wkly_sales_amt)",
    "avg_units": "avg(wkly_qty)", "total_units": "sum(wkly_qty)", "avg_inventory": "avg(onhand_invt_qty)",
    "std_inventory": "stddev_samp(onhand_invt_qty)", "avg_ratio": "avg(sales_to_inventory_ratio)",
}
PRICE_SET = {
    "avg_price": "avg(live_price_amt)", "std_price": "stddev_samp(live_price_amt)", "avg_gap": "avg(gap_reg_live)",
    "promo_rate": "avg(cast(on_promotion as int))", "records": "count(wm_wk_nbr)",
}


def kmeans_sql(features: dict[str, str], source: str) -> str:
    """Farthest-point start and Lloyd steps as recursive queries over whole standardised numbers."""
    held = ", ".join(f"round(cast({e} as double), 3) as {n}" for n, e in features.items())
    full = " and ".join(f"{n} is not null" for n in features)
    at = ", ".join(
        f"cast(round(coalesce(({n} - (avg({n}) over ())) / nullif(stddev_samp({n}) over (), 0), 0) * 10000) + 10000000 as bigint)" for n in features
    )
    means = ", ".join(f"(2 * sum(w.p[{d}]) + count(*)) // (2 * count(*))" for d in range(1, len(features) + 1))
    apart = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip({}, {})])"
    return f"""with recursive f as (select * from (select store_nbr, {held} from {source} group by 1) where {full}),
pts as (select store_nbr, [{at}] as p from f),
size as (select case when count(*) <= 10 then 0 else greatest(2, least(5, count(*) // 3)) end as k from pts),
start as (
  select [p] as chosen from (select p from pts order by store_nbr limit 1) union all
  select list_append(any_value(chosen), arg_min(p, (-near, store_nbr))) from (
    select chosen, store_nbr, p, (select min({apart.format("p", "c.c")}) from (select unnest(chosen) as c) c) as near from start cross join pts)
  having max(near) > 0 and len(any_value(chosen)) < (select k from size)),
first as (select chosen from start order by len(chosen) desc limit 1),
walk as (
  select 0 as step, store_nbr, p, (select arg_min(i, ({apart.format("p", "chosen[i]")}, i)) from (select unnest(range(1, len(chosen) + 1)) as i) x) - 1 as cluster
  from pts cross join first union all
  select any_value(step) + 1, store_nbr, any_value(p), arg_min(cluster, ({apart.format("p", "center")}, cluster)) from (
    select q.store_nbr, q.p, c.step, c.cluster, c.center from pts q cross join (
      select any_value(w.step) as step, w.cluster, [{means}] as center from walk w group by w.cluster) c)
  where step < 25 group by store_nbr)
select f.*, cast(cluster as int) as cluster from walk join f using (store_nbr) where step = 25 and (select k from size) > 0"""


SALES_CLUSTERS, PRICE_CLUSTERS = kmeans_sql(SALES_SET, "sales_m"), kmeans_sql(PRICE_SET, "price_m")
query("store_clusters_by_sales", "J136", f"select * from ({SALES_CLUSTERS})", ",".join(SALES_SET) + ":3")(lambda v: cluster.store_clusters(sales(v)))
query("store_clusters_by_price", "J136", f"select * from ({PRICE_CLUSTERS})", ",".join(PRICE_SET) + ":3")(lambda v: cluster.store_clusters(prices(v)))
query(
    "cluster_summary",
    "J136",
    f"select cluster, avg(avg_price) as avg_price, avg(std_price) as std_price, count(*) as stores from ({PRICE_CLUSTERS}) group by 1",
    "avg_price,std_price:6",
)(lambda v: cluster.cluster_summary(cluster.store_clusters(prices(v)), ["avg_price", "std_price"]))
query(
    "cluster_profile",
    "J137",
    f"with c as (select * from ({SALES_CLUSTERS})), m as (select median(avg_sales) as s, median(avg_inventory) as i from c), "
    "g as (select cluster, avg(avg_sales) as avg_sales, avg(avg_inventory) as avg_inventory, count(*) as stores from c group by 1) "
    "select g.*, case when avg_sales > s and avg_inventory < i then 'High Performance (High Sales, Low Inventory)' when avg_sales > s then 'High Volume' "
    "when avg_inventory < i then 'Lean Operations' else 'Standard Operations' end as profile from g cross join m",
    "avg_sales,avg_inventory:6",
)(lambda v: cluster.cluster_profile(cluster.store_clusters(sales(v))))
query("store_pca_2d", "J138")(lambda v: cluster.pca_2d(sales(v)))
