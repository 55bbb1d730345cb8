"""Store clustering on standardised per-store features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import numbers_by
from ..functions.columns import rate
from ..functions.running import quantiles_row
from ..session import materialize
from . import kmeans
from .series import total


def _rounded(df: DataFrame, store: str) -> DataFrame:
    names = [c for c in df.columns if c != store]
    return df.select(store, *[F.round(F.col(c).cast("double"), 3).alias(c) for c in names]).dropna()


def sales_features(df: DataFrame, store: str = "store_nbr") -> DataFrame:
    """Sales, units and inventory per store, rounded to 3 digits; stores with a gap are dropped."""
    sales, qty, stock = "wkly_sales_amt", "wkly_qty", "onhand_invt_qty"
    return _rounded(
        numbers_by(
            df,
            [store],
            {
                "avg_sales": F.avg(sales),
                "std_sales": F.stddev_samp(sales),
                "total_sales": total(sales),
                "avg_units": F.avg(qty),
                "total_units": total(qty),
                "avg_inventory": F.avg(stock),
                "std_inventory": F.stddev_samp(stock),
                "avg_ratio": F.avg("sales_to_inventory_ratio"),
            },
        ),
        store,
    )


def price_features(df: DataFrame, store: str = "store_nbr") -> DataFrame:
    price = "live_price_amt"
    return _rounded(
        numbers_by(
            df,
            [store],
            {
                "avg_price": F.avg(price),
                "std_price": F.stddev_samp(price),
                "avg_gap": F.avg("gap_reg_live"),
                "promo_rate": rate(F.col("on_promotion")),
                "records": F.count("wm_wk_nbr"),
            },
        ),
        store,
    )


def _scaled(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(features)
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)
    return scaler.fit(vectors).transform(vectors)


def store_clusters(
    features: DataFrame, store: str = "store_nbr", min_stores: int = 10, clusters: int | None = None
) -> DataFrame:
    """Features with a ``cluster`` number; ``clusters`` of them, or min(5, stores // 3).

    Empty with ``min_stores`` or fewer (0 switches this off).
    """
    features = materialize(features)  # one row per store; every k-means pass reads the same rows
    stores = features.count()
    if stores <= min_stores:
        return features.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    columns = [c for c in features.columns if c != store]
    return kmeans.clustered(features, store, columns, clusters or max(2, min(5, stores // 3)))


def cluster_summary(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("stores")
    )


def cluster_profile(clustered: DataFrame, sales: str = "avg_sales", stock: str = "avg_inventory") -> DataFrame:
    """Name each cluster by its mean sales and inventory against the medians over stores."""
    clustered = materialize(clustered)  # one row per store
    median = quantiles_row(clustered, [sales, stock])
    high, lean = F.col(sales) > median[sales], F.col(stock) < median[stock]
    # fixed values: the four cluster names
    name = (
        F.when(high & lean, "High Performance (High Sales, Low Inventory)")
        .when(high, "High Volume")
        .when(lean, "Lean Operations")
        .otherwise("Standard Operations")
    )
    return cluster_summary(clustered, [sales, stock]).withColumn("profile", name)


def pca_2d(features: DataFrame, store: str = "store_nbr", columns: Sequence[str] | None = None) -> DataFrame:
    """Scores on the first two components of the standardised features, with their variance shares."""
    features = materialize(features)
    columns = list(columns or [c for c in features.columns if c not in (store, "cluster")])
    data = _scaled(features, columns)
    model = PCA(k=2, inputCol="_scaled", outputCol="_score").fit(data)
    shares = [float(x) for x in model.explainedVariance.toArray()]
    score = vector_to_array("_score")
    return model.transform(data).select(
        store,
        score[0].alias("pc1"),
        score[1].alias("pc2"),
        F.lit(shares[0]).alias("pc1_share"),
        F.lit(shares[1]).alias("pc2_share"),
    )
