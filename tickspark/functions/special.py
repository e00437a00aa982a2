"""Normal, Student, chi-square and F distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed coefficients: error function by a polynomial (Abramowitz and Stegun 7.1.26), normal quantile by ratios (Acklam).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
Q_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
Q_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
Q_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
Q_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(x: Column, cs: tuple[float, ...]) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    y = 1 - _poly(t, (*reversed(ERF), 0.0)) * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2))) / 2


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_quantile(p: Column) -> Column:
    """Null outside (0, 1)."""
    low, high = 0.02425, 1 - 0.02425
    side = lambda q: _poly(q, Q_C) / _poly(q, Q_D)
    q = p - 0.5
    middle = q * _poly(q * q, Q_A) / _poly(q * q, Q_B)
    inside = (p > 0) & (p < 1)
    safe_p = F.when(inside, p)
    return F.when(safe_p < low, side(F.sqrt(-2 * F.ln(safe_p)))).when(safe_p <= high, middle).when(inside, -side(F.sqrt(-2 * F.ln(1 - safe_p))))


def inc_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if not (a > 0 and x > 0):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 500):
            term *= x / (a + k)
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return min(front * total, 1.0)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(1 - front * h, 0.0)


def inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - inc_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _t(x: float, v: float) -> float:
    half = inc_beta(v / 2, 0.5, v / (v + x * x)) / 2
    return 1 - half if x > 0 else half


def _batch(f, n: int):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in v) else f(*v) for v in zip(*cols, strict=True)], dtype="float64")

    if n == 2:
        return F.pandas_udf(lambda a, b: run(a, b), "double")
    return F.pandas_udf(lambda a, b, c: run(a, b, c), "double")


def t_cdf(x: Column, v: Column) -> Column:
    """Student t; meant for aggregated rows, one per key."""
    return _batch(_t, 2)(x, v.cast("double"))


def t_pdf(x: Column, v: Column) -> Column:
    return _batch(lambda a, k: math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + a * a / k) ** (-(k + 1) / 2), 2)(x, v.cast("double"))


def chi2_cdf(x: Column, v: Column) -> Column:
    return _batch(lambda a, k: inc_gamma(k / 2, a / 2), 2)(x, v.cast("double"))


def f_cdf(x: Column, d1: Column, d2: Column) -> Column:
    return _batch(lambda a, m, n: inc_beta(m / 2, n / 2, m * a / (m * a + n)) if a > 0 else 0.0, 3)(x, d1.cast("double"), d2.cast("double"))
