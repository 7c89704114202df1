"""Tail probabilities for test statistics.

Statistics are computed by Spark aggregates; these Arrow UDFs only see the few result rows of a test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


STEPS = 100_000  # of the continued fraction; fewer than a hundred are usual


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, STEPS):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return total
    raise ArithmeticError(f"the incomplete beta function does not converge at a={a}, b={b}, x={x}")


def _log_gamma_ratio(a: float, b: float) -> float:
    """ln(Gamma(a + b) / Gamma(a)); for a large ``a`` by Stirling's series, where the two logarithms would cancel."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    end = a + b
    series = (1 / end - 1 / a) / 12 - (1 / end**3 - 1 / a**3) / 360
    return (a - 0.5) * math.log1p(b / a) + b * math.log(end) - b + series


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 - x, for an x too near 1 to give it."""
    y = 1.0 - x if y is None else y
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    log_x, log_y = (math.log1p(-y) if y < 0.5 else math.log(x)), (math.log1p(-x) if x < 0.5 else math.log(y))
    small, large = sorted((a, b))
    front = math.exp(_log_gamma_ratio(large, small) - math.lgamma(small) + a * log_x + b * log_y)
    # Near x = 1 the first fraction loses its digits; the second one keeps them as long as the tail is not vanishing.
    if x < (a + 1) / (a + b + 2) and not (y < 1e-3 and a * y < 700):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not (df1 > 0 and df2 > 0) or math.isnan(f):
        return math.nan
    if math.isinf(f):
        return 0.0
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the closed recurrence over degrees of freedom."""
    half = x / 2
    if df % 2 == 0:
        term, total = math.exp(-half), 0.0
        for i in range(df // 2):
            total += term
            term *= half / (i + 1)
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return total


def chi2_quantile(p: float, df: int) -> float:
    """Chi-squared quantile by bisection on the tail."""
    low, high = 0.0, 10.0 * df + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def _column(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _column(f_tail, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return _column(normal_tail, z)
