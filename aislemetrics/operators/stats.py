"""Significance tests, correlation matrices and component shares, computed from moments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import correlation, tall_moments
from ..functions.columns import has_keys
from ..functions.pvalues import chi2_2_pvalue, f_pvalue, t_pvalue


def anova_oneway(df: DataFrame, value: str, group: str, level: float = 0.05) -> DataFrame:
    """One-way analysis of variance from per-group moments."""
    known = has_keys(df, group, value)
    per = known.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    # from the groups, whose exchange serves both: the rows are read once
    mean = per.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("m")).scalar()
    sums = per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - mean, F.lit(2))).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"),
    )
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide("ss_between", d1), F.try_divide("ss_within", d2))
    out = sums.where("groups > 1").withColumn("f", f)
    out = out.withColumn("p_value", f_pvalue(F.col("f"), d1, d2))
    return out.select("groups", "n", "f", "p_value", (F.col("p_value") < level).alias("significant"))


def ttest(
    df: DataFrame, value: str, first: Column, second: Column, equal_var: bool = True, min_n: int = 10, level: float = 0.05
) -> DataFrame:
    """Two-sample t test (pooled, or Welch) between the rows of two conditions, in one pass."""
    x = {1: F.when(first, F.col(value)), 2: F.when(second, F.col(value))}
    moments = df.agg(
        *[f(x[i]).alias(f"{n}{i}") for i in (1, 2) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    ).where((F.col("n1") > min_n) & (F.col("n2") > min_n))
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    if equal_var:
        df_ = (n1 + n2 - 2).cast("double")
        error = ((n1 - 1) * v1 + (n2 - 1) * v2) / df_ * (1 / n1 + 1 / n2)
    else:
        a, b = v1 / n1, v2 / n2
        error = a + b
        df_ = F.try_divide(error * error, a * a / (n1 - 1) + b * b / (n2 - 1))
    out = moments.withColumns({"t": F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(error)), "df": df_})
    out = out.withColumn("p_value", t_pvalue(F.col("t"), F.col("df")))
    return out.select("n1", "n2", "mean1", "mean2", "t", "df", "p_value", (F.col("p_value") < level).alias("significant"))


def _skew_score(n: Column, skew: Column) -> Column:
    """Normal score of a sample skewness (D'Agostino)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)  # an exact 0 counts as 1, as in common libraries
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    return F.asinh(y / alpha) / F.sqrt(0.5 * F.log(w2))


def _kurtosis_score(n: Column, excess: Column) -> Column:
    """Normal score of a sample kurtosis (Anscombe and Glynn)."""
    expected = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - expected) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    den = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(den) * F.cbrt(F.try_divide(1 - 2 / a, F.abs(den)))
    return (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))


def normality_test(df: DataFrame, columns: Sequence[str], min_n: int = 8, level: float = 0.05) -> DataFrame:
    """Skewness, excess kurtosis and the omnibus K squared test per column, all closed form."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    moments = tall_moments(data, columns, {"n": F.count, "skewness": F.skewness, "kurtosis": F.kurtosis})
    moments = moments.where(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    z1, z2 = _skew_score(n, F.col("skewness")), _kurtosis_score(n, F.col("kurtosis"))
    out = moments.withColumn("k2", z1 * z1 + z2 * z2).withColumn("p_value", chi2_2_pvalue(F.col("k2")))
    return out.withColumn("normal", F.when(F.col("p_value") < level, "No").otherwise("Possibly"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], complete: bool = False) -> DataFrame:
    """Correlations in long form, one pass. ``complete`` uses rows without any NULL, else pairs."""
    data = df.dropna(subset=list(columns)) if complete else df
    pairs = list(combinations(columns, 2))
    wide = data.agg(
        *[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[correlation(F.col(c), F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    )

    def cell(a, b, r):
        return F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(r).alias("r"))

    cells = [cell(a, b, f"r{i}") for i, (a, b) in enumerate(pairs)]
    cells += [cell(b, a, f"r{i}") for i, (a, b) in enumerate(pairs)]
    cells += [cell(c, c, f"d{i}") for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*cells)))


def strong_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.7, complete: bool = False) -> DataFrame:
    """Column pairs, each once, with an absolute correlation above ``threshold``."""
    place = {c: i for i, c in enumerate(columns)}
    index = F.create_map(*[F.lit(x) for c, i in place.items() for x in (c, i)])
    matrix = correlation_matrix(df, columns, complete)
    return matrix.where((index[F.col("column_a")] < index[F.col("column_b")]) & (F.abs("r") > threshold))


def pca_explained(df: DataFrame, columns: Sequence[str], min_rows: int = 50, min_columns: int = 3) -> DataFrame:
    """Explained and cumulative variance share of the components of standardised columns.

    Empty with fewer than ``min_columns`` columns or at most ``min_rows`` complete rows. The scaler and the
    component fit aggregate a columns x columns matrix; only its eigenvalues reach the driver.
    """
    schema = "component int, explained double, cumulative double"
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if len(columns) < min_columns or len(data.select(columns[0]).take(min_rows + 1)) <= min_rows:
        return df.sparkSession.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(data).select("raw")
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(vectors).transform(vectors)
    shares = PCA(k=len(columns), inputCol="scaled", outputCol="score").fit(scaled).explainedVariance.toArray()
    rows = [(i + 1, float(e), float(shares[: i + 1].sum())) for i, e in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, schema)
