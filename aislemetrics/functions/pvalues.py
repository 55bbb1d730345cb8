"""Tail probabilities of the t, F and chi-square(2) distributions, for aggregated rows only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    floor = 1e-300

    def guard(v):
        return np.where(np.abs(v) < floor, floor, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / guard(1.0 + even * d), guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / guard(1.0 + odd * d), guard(1.0 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    left = inner < (a + 1) / (a + b + 2)
    value = np.where(
        left,
        front * _beta_fraction(a, b, inner) / a,
        1.0 - front * _beta_fraction(b, a, 1 - inner) / b,
    )
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    tv, v = t[ok].to_numpy(float), df[ok].to_numpy(float)
    out[ok] = incomplete_beta(v / 2, 0.5, v / (v + tv * tv))
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = f.notna() & d1.notna() & d2.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series(np.nan, index=f.index)
    fv, a, b = (s[ok].to_numpy(float) for s in (f, d1, d2))
    out[ok] = incomplete_beta(b / 2, a / 2, b / (b + a * fv))
    return out.astype(object).where(out.notna(), None)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _t_two_sided(t.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    """Upper-tail p of F with (d1, d2) degrees of freedom."""
    return _f_upper(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_2_pvalue(x: Column) -> Column:
    """Upper-tail p of chi-square with two degrees of freedom."""
    return F.exp(-x / 2)
