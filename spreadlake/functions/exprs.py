"""Column expressions: safe arithmetic, scores, sizes, normal distribution, deflated Sharpe terms.

Missing is NULL everywhere, never NaN; a division by zero or a non-finite result is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x kept in lo to hi; missing stays missing (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def linear_score(value: Column, worst: float, best: float) -> Column:
    """Share of the way from worst to best, kept in 0 to 1; 0 for a missing value or an empty span."""
    if abs(best - worst) <= 1e-12:
        return F.lit(0.0)
    return F.coalesce(clip((value - worst) / (best - worst), 0.0, 1.0), F.lit(0.0))


def trapezoid_score(value: Column, lo: float, sweet_lo: float, sweet_hi: float, hi: float) -> Column:
    """0 outside lo..hi, 1 inside the sweet spot, linear between."""
    rise = (value - lo) / (sweet_lo - lo) if sweet_lo > lo else F.lit(0.0)
    fall = (hi - value) / (hi - sweet_hi) if hi > sweet_hi else F.lit(0.0)
    return F.when(value.isNull() | (value < lo) | (value > hi), 0.0).when(value.between(sweet_lo, sweet_hi), 1.0).when(value < sweet_lo, rise).otherwise(fall)


def dollar_neutral(price_a: Column, mult_a: float, price_b: Column, mult_b: float, beta: Column, n_a: Column) -> Column:
    """Contracts of leg B, half to even, at least one; 1 where the ratio is unknown."""
    raw = div(price_a * mult_a, price_b * mult_b) * F.abs(F.coalesce(beta, F.lit(1.0))) * n_a
    return F.coalesce(F.greatest(F.bround(raw, 0), F.lit(1.0)), F.lit(1.0)).cast("int")


def best_multiplier(ratio: Column, most: int) -> Column:
    """struct(error, m, n_b): the lot multiplier with the least rounding error, the smallest of equals; (0, 1, 1) for no ratio."""
    options = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda m: F.struct(F.abs(F.bround(ratio * m, 0) - ratio * m).alias("error"), m.alias("m"), F.bround(ratio * m, 0).cast("int").alias("n_b")))
    usable = F.filter(options, lambda o: o["n_b"] >= 1)
    fallback = F.struct(F.lit(0.0).alias("error"), F.lit(1).alias("m"), F.lit(1).alias("n_b"))
    return F.when(ratio.isNull() | (ratio <= 0) | (F.size(usable) == 0), fallback).otherwise(F.array_min(usable))


#: The coefficients of the rational approximation 26.2.17 of the normal distribution in Abramowitz and Stegun.
_PHI = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error under 7.5e-8, in code that stays in the JVM."""
    t = 1.0 / (1.0 + _PHI[0] * F.abs(x))
    poly = t * (_PHI[1] + t * (_PHI[2] + t * (_PHI[3] + t * (_PHI[4] + t * _PHI[5]))))
    tail = F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {_PHI[0]} * abs({x})))"
    poly = f"{t} * ({_PHI[1]} + {t} * ({_PHI[2]} + {t} * ({_PHI[3]} + {t} * ({_PHI[4]} + {t} * {_PHI[5]}))))"
    return f"(CASE WHEN {x} >= 0 THEN 1.0 - exp(-({x}) * ({x}) / 2.0) / sqrt(2 * pi()) * {poly} ELSE exp(-({x}) * ({x}) / 2.0) / sqrt(2 * pi()) * {poly} END)"


def expected_max_sharpe(n: Column, mean: Column, std: Column) -> Column:
    """Expected largest of n Sharpe ratios under the null; the mean for n <= 1."""
    root = F.sqrt(2 * F.log(n))
    extreme = root - (math.log(math.pi) + F.log(F.log(n))) / (2 * root)
    return F.when(n <= 1, mean).otherwise(mean + std * extreme)


def deflated_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a Sharpe ratio exceeds its benchmark; kurt is raw.  0 for n < 3 or no variance."""
    var = (1 - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / (n - 1)
    return F.when((n < 3) | var.isNull() | (var <= 0), 0.0).otherwise(normal_cdf((sharpe - benchmark) / F.sqrt(F.when(var > 0, var))))
