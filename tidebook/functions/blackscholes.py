"""Option pricing as column expressions.

The normal CDF is the Abramowitz-Stegun 26.2.17 polynomial (absolute error
below 7.5e-8): PySpark has no ``erf``, and a polynomial stays inside code
generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.exprs import col
from tidebook.functions.solvers import implied_vol_column

# Polynomial coefficients of 26.2.17.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

RISK_FREE = 0.065


def norm_pdf(x: str | Column) -> Column:
    v = col(x)
    return F.exp(-0.5 * v * v) / math.sqrt(2 * math.pi)


def norm_cdf(x: str | Column) -> Column:
    v = col(x)
    k = 1.0 / (1.0 + _P * F.abs(v))
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = k * (b + poly)
    tail = norm_pdf(v) * poly
    return F.when(v >= 0, 1.0 - tail).otherwise(tail)


def d1(s, k, t, r, sigma) -> Column:
    return (F.log(s / k) + (r + 0.5 * sigma * sigma) * t) / (sigma * F.sqrt(t))


def intrinsic(s, k, is_call: Column) -> Column:
    return F.greatest(F.when(is_call, s - k).otherwise(k - s), F.lit(0.0))


def price(s, k, t, r, sigma, is_call: Column) -> Column:
    """European price; intrinsic when no time or no volatility is left."""
    a = d1(s, k, t, r, sigma)
    b = a - sigma * F.sqrt(t)
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    live = sign * (s * norm_cdf(sign * a) - k * F.exp(-r * t) * norm_cdf(sign * b))
    return F.when((t > 0) & (sigma > 0), live).otherwise(intrinsic(s, k, is_call))


def vega(s, k, t, r, sigma) -> Column:
    return s * F.sqrt(t) * norm_pdf(d1(s, k, t, r, sigma))


class IvVariant:
    """Constants of one Newton solver; the variants differ in start value,
    price floor, tolerance, clamp and in what an unsolved row returns."""

    def __init__(self, start, steps, tol, vega_min, lo, hi, min_price, unsolved, intrinsic_margin=None):
        self.start, self.steps, self.tol, self.vega_min = start, steps, tol, vega_min
        self.lo, self.hi, self.min_price, self.unsolved = lo, hi, min_price, unsolved
        self.intrinsic_margin = intrinsic_margin


# Solver constants per use.
GREEKS = IvVariant(0.25, 60, 0.01, 1e-8, 0.001, 10.0, 0.0, 0.0, intrinsic_margin=1.001)
HISTORICAL = IvVariant(0.3, 50, 1e-6, 1e-10, 1e-4, 2.0, 0.05, None, intrinsic_margin=1.0)
SKEW = IvVariant(0.25, 50, 1e-6, 1e-10, 1e-4, 2.0, 0.5, None)
LIVE = IvVariant(0.25, 50, 0.001, 1e-8, 0.01, 5.0, 0.0, 0.15)


def implied_vol(s, k, t, r: float, ltp, is_call: Column, v: IvVariant) -> Column:
    """Newton implied volatility; rows outside the price limits, or without a
    solution, get the variant's unsolved value."""
    s, k, t, ltp = (col(c).cast("double") for c in (s, k, t, ltp))
    ok = (t > 0) & (s > 0) & (k > 0) & (ltp > 0) & (ltp >= v.min_price)
    if v.intrinsic_margin is not None:
        floor = intrinsic(s, k, is_call) * v.intrinsic_margin
        ok = ok & (ltp > floor if v.intrinsic_margin > 1 else ltp >= floor)
    solved = implied_vol_column(s, k, t, float(r), ltp, is_call, v)
    return F.when(ok, solved).otherwise(F.lit(v.unsolved).cast("double"))


def delta(s, k, t, iv, is_call: Column, r: float = RISK_FREE) -> Column:
    live = (col(iv) > 0) & (col(t) > 0)
    n = norm_cdf(d1(col(s), col(k), col(t), F.lit(r), col(iv)))
    return F.when(live, F.when(is_call, n).otherwise(n - 1)).otherwise(F.when(is_call, 0.5).otherwise(-0.5))


def theta_per_day(s, k, t, iv, is_call: Column, r: float = RISK_FREE) -> Column:
    s, k, t, iv = (col(c) for c in (s, k, t, iv))
    a = d1(s, k, t, F.lit(r), iv)
    b = a - iv * F.sqrt(t)
    disc = r * k * F.exp(-r * t)
    decay = -(s * norm_pdf(a) * iv) / (2 * F.sqrt(t))
    carry = F.when(is_call, -disc * norm_cdf(b)).otherwise(-disc * norm_cdf(-b) + disc)
    return F.when((iv > 0) & (t > 0), (decay + carry) / 365.0).otherwise(0.0)


def straddle(s, k, t, iv) -> Column:
    """Call plus put at zero rate; 0 when an input is missing."""
    s, k, t, iv = (col(c) for c in (s, k, t, iv))
    z = F.lit(0.0)
    both = price(s, k, t, z, iv, F.lit(True)) + price(s, k, t, z, iv, F.lit(False))
    return F.when((t > 0) & (iv > 0) & (s > 0), both).otherwise(0.0)
