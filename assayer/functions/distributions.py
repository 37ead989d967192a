"""Distribution tails: normal ones as column expressions, the others for single statistics on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: published rational approximation of the normal quantile (relative error < 1.2e-9) ----
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
# error function, Abramowitz & Stegun 7.1.26 (absolute error < 1.5e-7)
_ERF_P, _ERF = .3275911, (.254829592, -.284496736, 1.421413741, -1.453152027, 1.061405429)
# -------------------------------------------------------------------------------------------


def _poly(x: Column, coef) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - .5
    tail = lambda t: _poly(t, _C) / _poly(t, (*_D, 1.0))
    mid = q * _poly(q * q, _A) / _poly(q * q, (*_B, 1.0))
    return F.when(p < .02425, tail(low)).when(p > 1 - .02425, -tail(high)).otherwise(mid)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * z)
    erf = 1 - t * _poly(t, tuple(reversed(_ERF))) * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square by series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_reg(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_reg(df / 2, .5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_reg(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0
