"""Distribution functions as column expressions, and exact ones for small result tables."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the Chebyshev series behind erfc.
TERMS = 28


def _scaled_erfc(x: float) -> float:
    """exp(x x) erfc(x), by a continued fraction where erfc itself is small."""
    if x < 2:
        return math.exp(x * x) * math.erfc(x)
    tail = 0.0
    for k in range(200, 0, -1):
        tail = k / 2 / (x + tail)
    return 1 / math.sqrt(math.pi) / (x + tail)


@functools.cache
def _erfc_series() -> list[float]:
    """Chebyshev coefficients of ln(exp(x x) erfc(x) / t) in t = 2 / (2 + x), for t from 0 to 1."""
    nodes = np.cos(np.pi * (np.arange(4 * TERMS) + 0.5) / (4 * TERMS))
    t = (nodes + 1) / 2
    values = [math.log(_scaled_erfc(2 / u - 2) / u) for u in t]
    return np.polynomial.chebyshev.chebfit(nodes, values, TERMS - 1).tolist()


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error about 1e-12."""
    t = 2 / (2 + x)
    y, (first, *rest) = 4 * t - 2, _erfc_series()
    d, dd = F.lit(0.0), F.lit(0.0)
    cells = F.array(*(F.lit(c) for c in reversed(rest)))
    # Clenshaw's recurrence as a fold, so that no expression is written out twice.
    state = F.aggregate(cells, F.struct(d.alias("d"), dd.alias("e")), lambda a, c: F.struct((y * a["d"] - a["e"] + c).alias("d"), a["d"].alias("e")))
    return t * F.exp(-x * x + first + y / 2 * state["d"] - state["e"])


def normal_cdf(z: Column) -> Column:
    tail = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def chi2_sf(x: Column, df: int) -> Column:
    """P(chi-square with df degrees > x): a finite sum, with erfc for odd df."""
    half = x / 2
    if df % 2 == 0:
        total, term = F.lit(0.0), F.lit(1.0)
        for i in range(df // 2):
            total = total + term
            term = term * half / (i + 1)
        return F.exp(-half) * total
    total, term = F.lit(0.0), F.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total = total + term
        term = term * half / (i + 1.5)
    return erfc(F.sqrt(half)) + F.exp(-half) * total


def chi2_sf_exact(x: float, df: int) -> float:
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(df // 2))
    return math.erfc(math.sqrt(half)) + math.exp(-half) * sum(half ** (i + 0.5) / math.gamma(i + 1.5) for i in range((df - 1) // 2))


def chi2_quantile(upper: Column, df: int, steps: int = 60) -> Column:
    """x with P(chi-square with df degrees > x) = upper, for 0 < upper < 1; null elsewhere.

    A fold over a fixed number of steps: Newton's on ln P, or half the bracket where that
    would leave it, so no value's search runs on.
    """
    log_density = lambda x: (df / 2 - 1) * F.ln(x) - x / 2 - (df / 2) * math.log(2) - math.lgamma(df / 2)
    # Chernoff's bound: P is under upper at df + 2 sqrt(df t) + 2 t, t = -ln upper.
    t = -F.ln(upper)
    top = df + 2 * F.sqrt(df * t) + 2 * t
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"), F.least(F.lit(float(df)), top / 2).alias("x"), F.lit(0.0).alias("last"))

    def step(a: Column, _: Column) -> Column:
        sf = chi2_sf(a["x"], df)
        lo, hi = F.when(sf > upper, a["x"]).otherwise(a["lo"]), F.when(sf > upper, a["hi"]).otherwise(a["x"])
        guess = a["x"] + (F.ln(sf) - F.ln(upper)) * sf / F.exp(log_density(a["x"]))
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when((guess > lo) & (guess < hi), guess).otherwise((lo + hi) / 2).alias("x"), a["x"].alias("last"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["x"])
    return F.when((upper > 0) & (upper < 1), found)


def chi2_quantile_exact(upper: float, df: int) -> float:
    """As chi2_quantile, for one value."""
    lo, hi = 0.0, df + 2 * math.sqrt(-df * math.log(upper)) - 2 * math.log(upper)
    while hi - lo > 1e-13 * hi:
        x = (lo + hi) / 2
        lo, hi = (x, hi) if chi2_sf_exact(x, df) > upper else (lo, x)
    return (lo + hi) / 2


def normal_cdf_exact(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


#: Chi-square quantiles with 3 degrees of freedom at 10, 5 and 1 percent, as published tables round them.
CHI2_3 = {10: 6.2514, 5: 7.8147, 1: 11.3449}
#: Coefficients of the response surface of the unit-root p-value (constant,
#: one series): below TAU_STAR the small polynomial, above it the large one.
TAU_MIN, TAU_MAX, TAU_STAR = -18.83, 2.74, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: Column) -> Column:
    """p-value of a unit-root t statistic with a constant."""

    def poly(c: tuple[float, ...]) -> Column:
        total = F.lit(0.0)
        for a in reversed(c):
            total = total * tau + a
        return total

    inside = normal_cdf(F.when(tau <= TAU_STAR, poly(TAU_SMALL)).otherwise(poly(TAU_LARGE)))
    return F.when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).otherwise(inside)
