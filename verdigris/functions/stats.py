"""Distribution functions and effect sizes as column expressions; Student's t in numpy.

The t distribution has no built-in function. Its two-sided probabilities and quantiles are computed
on aggregated rows only (one per comparison), in Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Acklam's rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_TAIL = 0.02425


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    return F.signum(x) * (1 - _horner(t, [*reversed(ERF_A), 0.0]) * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / F.sqrt(F.lit(2.0)))) / 2


def normal_quantile(p: Column) -> Column:
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    mid = p - 0.5
    sq = mid * mid
    tail = lambda q: _horner(q, QUANTILE_C) / _horner(q, [*QUANTILE_D, 1.0])
    return (
        F.when(p <= 0, F.lit(float("-inf")))
        .when(p >= 1, F.lit(float("inf")))
        .when(p < QUANTILE_TAIL, tail(low))
        .when(p <= 1 - QUANTILE_TAIL, _horner(sq, QUANTILE_A) * mid / _horner(sq, [*QUANTILE_B, 1.0]))
        .otherwise(-tail(high))
    )


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """Probability of a value at least as far from 0 as t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Bisection on -10 .. 10 to 1e-6, at most 100 steps."""
    low, high = -10.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        tail = t_two_sided(mid, df) / 2
        if (1 - tail if mid > 0 else tail) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-6:
            break
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_quantile_small(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(b) or b > 30 else t_quantile(a, b) for a, b in zip(p, df)], dtype="float64")


def quantile_t(p: Column, df: Column) -> Column:
    """Student's quantile up to 30 degrees of freedom, the normal one beyond."""
    return F.when(df > 30, normal_quantile(p)).otherwise(_t_quantile_small(p, df))


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
