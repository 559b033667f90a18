"""Special functions.  Those that are expressions stay in generated code; those
Spark has no expression for are Arrow-batched UDFs, applied to one row for each
dimension or distinct parameter, never to data rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The published coefficients of Acklam's normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_BREAK = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to about 1e-9; NaN outside (0, 1)."""
    p = p.cast("double")
    inside = (p > 0) & (p < 1)
    safe = F.when(inside, p).otherwise(0.5)
    centre = safe - 0.5
    square = centre * centre
    middle = centre * _horner(_A, square) / _horner((*_B, 1.0), square)
    far = F.sqrt(-2 * F.ln(F.least(safe, 1 - safe)))
    tail = _horner(_C, far) / _horner((*_D, 1.0), far)
    value = F.when(safe < _BREAK, tail).when(safe > 1 - _BREAK, -tail).otherwise(middle)
    return F.when(inside, value).otherwise(float("nan"))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, tol = 1e-300, sys.float_info.epsilon
    guard = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 201):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / guard(1.0 + term * d)
            c = guard(1.0 + term / c)
            out *= d * c
        if abs(d * c - 1.0) < tol:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function; x is clamped to [0, 1]."""
    if math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic; NaN if t is not finite or df <= 0."""
    if not math.isfinite(t) or not df > 0:
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_point(p: float, df: float) -> float:
    """The t quantile, by bisection; ends and df <= 0 give infinities."""
    if p <= 0 or p >= 1:
        return math.inf if p >= 1 else -math.inf
    if p == 0.5:
        return 0.0
    if not df > 0:
        return math.inf
    if p < 0.5:
        return -t_point(1 - p, df)
    want, low, high = 2 * (1 - p), 0.0, 1.0
    while t_tail(high, df) > want:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > want else (low, mid)
        if high - low <= 1e-14 * high:
            break
    return (low + high) / 2


def _udf(f: Callable[..., float]):
    """f over Arrow batches; NaN stays NaN (pandas would make it null)."""

    @F.pandas_udf(T.DoubleType())
    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*v) for v in zip(*columns, strict=True)], dtype="float64")

    return lambda *args: F.coalesce(batch(*args), F.lit(math.nan))


t_quantile = _udf(t_point)
t_pvalue = _udf(t_tail)
beta_regularised = _udf(beta_inc)
erfc = _udf(math.erfc)
