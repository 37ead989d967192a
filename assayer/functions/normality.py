"""Closed-form normality statistics as column expressions over (n, skewness, excess kurtosis)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def k_squared(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson K2 from population moments; null below 8 values or without variance."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    r = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.asinh(r) / F.sqrt(F.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / F.sqrt(var)
    g = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / g * (2 / g + F.sqrt(1 + 4 / (g * g)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.pow(F.try_divide(1 - 2 / a, F.abs(d)), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    ok = (n >= 8) & skew.isNotNull() & kurt.isNotNull() & ~F.isnan(skew) & ~F.isnan(kurt)
    return F.when(ok, z_skew * z_skew + z_kurt * z_kurt)


def jarque_bera(n: Column, skew: Column, kurt: Column) -> Column:
    return n / 6 * (skew * skew + kurt * kurt / 4)


def chi2_two_tail(stat: Column) -> Column:
    """Upper tail of a chi-square with two degrees of freedom."""
    return F.exp(-stat / 2)


def corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n.cast("double") * (n - 1)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
