"""Scalar statistics as Spark expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio0(num, den) -> Column:
    """num/den as double, 0 when the denominator is 0 (undefined metric)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


#: Gauss-Legendre nodes and weights on [0, 1].
_NODES = [((1 + x) / 2, w / 2) for x, w in zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(40)), strict=True)]
#: log k! - ((k + 1/2) log k - k + log(2 pi) / 2) is written as a series from this k on.
_SERIES_FROM = 16


def _stirling_rest(k: Column) -> Column:
    """log k! less Stirling's formula: from the factorial where that is exact,
    else four terms of the series."""
    k = F.greatest(k, F.lit(1))
    d = k.cast("double")
    small = F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double")) - (d + 0.5) * F.log(d) + d - 0.5 * math.log(2 * math.pi)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (d * d)) / (d * d)) / (d * d)) / d
    return F.when(k < _SERIES_FROM, small).otherwise(series)


def half_binomial_pmf(x: Column, n: Column) -> Column:
    """P(X = x) for X ~ Bin(n, 1/2), 0 <= x <= n / 2, by deviances from the
    mean instead of factorials, so that nothing large cancels."""
    xd, nd = x.cast("double"), n.cast("double")
    m = nd / 2
    d = (m - xd) / F.greatest(m, F.lit(0.5))
    deviance = m * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    log_f = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - deviance
    inside = F.exp(log_f) * F.sqrt(nd / (2 * math.pi * F.greatest(xd * (nd - xd), F.lit(0.5))))
    return F.when(x == 0, F.pow(F.lit(2.0), -nd)).otherwise(inside)


def mcnemar_midp(b, c) -> Column:
    """Mid-p McNemar test for discordant counts ``b``, ``c``:
    ``2 * P(X <= x) - P(X = x)`` with ``x = min(b, c)``, ``X ~ Bin(n, 1/2)``,
    ``n = b + c``. No counts: 1.

    The tail over the point, P(X <= x) / P(X = x), is the incomplete beta
    function ``(n - x) * integral of (1 - u)^(n - x - 1) (1 + u)^x over 0..1``.
    Its integrand falls from 1 like a normal curve or faster and is cut where
    it is below e^-45; 40 fixed nodes then give full precision, at any counts
    and at the same cost. Equal counts are 1 by symmetry (which the formula
    gives to ten digits as well).
    """
    b, c = _c(b).cast("bigint"), _c(c).cast("bigint")
    return F.when(b == c, F.lit(1.0)).otherwise(half_binomial_midp(F.least(b, c), b + c))


def half_binomial_midp(x: Column, n: Column) -> Column:
    """``2 * P(X <= x) - P(X = x)`` for X ~ Bin(n, 1/2), 0 <= x <= n / 2."""
    big, small = (n - x - 1).cast("double"), x.cast("double")
    slope, bend = big - small, F.greatest((n - 1).cast("double"), F.lit(0.0))
    upto = F.least(F.lit(1.0), F.try_divide(F.lit(90.0), slope + F.sqrt(slope * slope + 90 * bend)))
    upto = F.when(n < 2, F.lit(1.0)).otherwise(upto)
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in _NODES])
    value = F.aggregate(nodes, F.lit(0.0), lambda a, p: a + p["w"] * F.exp(big * F.log1p(-upto * p["t"]) + small * F.log1p(upto * p["t"])))
    tail = (n - x).cast("double") * upto * value
    return F.when(n == 0, F.lit(1.0)).otherwise(half_binomial_pmf(x, n) * (2 * tail - 1))
