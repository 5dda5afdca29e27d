"""Whole-series statistics and rank statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, normal_cdf
from ..sources.storage import table
from .rolling import _slope, ordered


def hurst_full(df: DataFrame, keys: list[str], x: str, order: str = "ts", most: int = 20) -> DataFrame:
    """hurst per key: slope of ln(population deviation of lagged differences) on ln(lag), kept in 0.01 to 0.99; NULL for fewer than most + 2 values."""
    at = ordered(keys, order)
    lags = range(2, most + 1)
    rows = df.filter(F.col(x).isNotNull()).withColumns({f"_d{k}": F.col(x) - F.lag(x, k).over(at) for k in lags})
    agg = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.stddev_pop(f"_d{k}").alias(f"_t{k}") for k in lags))
    ys = [F.when((F.col(f"_t{k}") > 1e-12) & (F.least(F.lit(most), F.floor(F.col("_n") / 2)) >= k), F.ln(F.when(F.col(f"_t{k}") > 1e-12, F.col(f"_t{k}")))) for k in lags]
    h = agg.withColumn("_h", _slope([math.log(k) for k in lags], ys))
    ok = (F.col("_n") >= most + 2) & F.col("_h").isNotNull()
    return h.select(*keys, F.when(ok, F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("_h")))).alias("hurst"))


def halflife_full(df: DataFrame, keys: list[str], x: str, order: str = "ts") -> DataFrame:
    """half_life per key from the lag-one regression of at least ten values; NULL unless mean-reverting."""
    rows = df.filter(F.col(x).isNotNull()).withColumn("_l", F.lag(x).over(ordered(keys, order)))
    agg = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.regr_slope(x, "_l").alias("_b"))
    ok = (F.col("_n") >= 10) & (F.col("_b") > 0) & (F.col("_b") < 1)
    return agg.select(*keys, F.when(ok, -math.log(2) / F.ln(F.when(ok, F.col("_b")))).alias("half_life"))


PARTS = 64


def _matched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """df with the further columns of other, null keys alike."""
    right = other.withColumnsRenamed({k: f"_on{i}" for i, k in enumerate(on)})
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return df.join(right, same).drop(*(f"_on{i}" for i in range(len(on))))


def value_ranks(df: DataFrame, keys: list[str], x: str, parts: int = PARTS, rows: Column | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, x, _n, _rank, _off: each distinct value of a key, how many rows hold it, their mean rank, from 1, and that less the key's mean rank.

    Values are counted first, so ties cost one row however many they are.  Approximate quantiles cut a key's values
    into `parts` ranges; the rows before a range come from a table of one row a range, those inside it from a
    window of a key and range.  So no task holds a key's values, and the ranks are exact wherever the cuts lie.
    rows: how many rows a row of df stands for (1); sums: further columns, summed by value.

    Values, cuts and the table of ranges are written to the shared folder: values are read three times, and a
    table that is known to be small is broadcast before the values are sent anywhere.
    """
    sums = sums or {}
    values = df.groupBy(*keys, x).agg((F.count("*") if rows is None else F.sum(rows)).alias("_n"), *(F.sum(c).alias(n) for n, c in sums.items()))
    values = table(values, "values")
    cuts = table(values.groupBy(*keys).agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000).alias("_cuts")), "cuts")
    dealt = _matched(values, cuts, keys)
    wide = math.isqrt(parts - 1) + 1  # a cut in every `wide` tells the run of cuts, those of the run the range
    beyond = lambda at: F.coalesce(F.get("_cuts", at) < F.col(x), F.lit(False)).cast("int")
    count = lambda places: sum((beyond(at) for at in places), F.lit(0))
    dealt = dealt.withColumn("_run", count(F.lit(i) for i in range(wide - 1, parts - 1, wide)) * wide)
    dealt = dealt.withColumn("_range", F.col("_run") + count(F.col("_run") + i for i in range(wide - 1))).drop("_cuts", "_run")
    totals = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))
    ranges = ordered(keys, "_range")
    ahead = F.coalesce(F.sum("_total").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_total").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum("_n").over(ordered([*keys, "_range"], x).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    before = table(totals.select(*keys, "_range", ahead.alias("_ahead"), every.alias("_all")), "ranges")
    placed = _matched(dealt.withColumn("_inside", inside), before, [*keys, "_range"])
    rank = F.col("_ahead") + F.col("_inside") + (F.col("_n") + 1) / 2
    return placed.select(*keys, x, "_n", *sums, rank.alias("_rank"), (rank - (F.col("_all") + 1) / 2).alias("_off"))


def _ranked(cells: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """cells, which stand for _n rows each, with the centred rank of each column (new name -> column) in place of it.

    Ranks are written to the shared folder: a small table is then known to be small and is broadcast, so the cells
    are not sent to the few tasks that hold its values.
    """
    out = cells
    for name, x in columns.items():
        ranks = table(value_ranks(cells, keys, x, rows=F.col("_n")).select(*keys, x, F.col("_off").alias(name)), "ranks")
        out = _matched(out, ranks, [*keys, x]).drop(x)
    return out


def _cells(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Each combination of values of a key (new name -> column) that has no null, and the rows _n that hold it; written, since ranks and joins read it."""
    named = df.select(*keys, *(F.col(c).alias(n) for n, c in columns.items()))
    for n in columns:
        named = named.filter(F.col(n).isNotNull())
    return table(named.groupBy(*keys, *columns).agg(F.count("*").alias("_n")), "cells")


def _correlated(cells: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n and rho of cells that stand for _n rows each.

    The ranks of x are joined to the cells; those of y are not: cells are summed by y, and the sums go along with its values.
    """
    r = _ranked(cells, keys, {"_rx": x})
    own = F.col("_rx") * F.col("_n")
    by = value_ranks(r, keys, y, rows=F.col("_n"), sums={"_sx": own, "_sxx": own * F.col("_rx")})
    total = by.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_sx") * F.col("_off")).alias("_c"), F.sum("_sxx").alias("_vx"), F.sum(F.col("_off") * F.col("_off") * F.col("_n")).alias("_vy"))
    return total.select(*keys, "n", (F.col("_c") / F.nullif(F.sqrt("_vx") * F.sqrt("_vy"), F.lit(0.0))).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return _correlated(_cells(df, keys, {"_x": x, "_y": y}), keys, "_x", "_y")


def spearman_within(df: DataFrame, keys: list[str], period: str, x: str, y: str, least: int = 10) -> DataFrame:
    """rho: the rank correlations inside each period (such as a year) of at least `least` rows, averaged by their rows; periods, n."""
    inside = spearman(df, [*keys, period], x, y).filter((F.col("n") >= least) & F.col("rho").isNotNull())
    return inside.groupBy(*keys).agg(F.count("*").alias("periods"), F.sum("n").alias("n"), (F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("rho"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n and r of the rows that have both; null without variance."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("_s"))
    return out.select(*keys, "n", (F.col("_c") / F.nullif(F.col("_s"), F.lit(0.0))).alias("r"))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (evaluated by Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = total
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(total - before) <= 1e-14 * abs(total):
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * total / a


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation by Student's t with n - 2 degrees of freedom; null for n < 3 or without r.

    It works on one row a group, so the Python function sees results, not data.
    """

    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or k < 3 else beta_share((k - 2) / 2, 0.5, max(0.0, 1 - x * x)) for x, k in zip(rs, ns, strict=True)], dtype=float)

    return F.pandas_udf(p, "double")(F.col(r).cast("double"), F.col(n).cast("double"))


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, given: str) -> DataFrame:
    """Rank correlation of what is left of the ranks of x and y behind their regressions on the rank of a third column.

    What is left is rounded to 6 places before it is ranked, so equal pairs of ranks tie.  Rows are counted by
    their three values first; ranks are centred, so the regressions go through the origin.
    """
    r = table(_ranked(_cells(df, keys, {"_x": x, "_y": y, "_t": given}), keys, {"_rx": "_x", "_rt": "_t", "_ry": "_y"}), "ranked")
    t = F.col("_rt") * F.col("_n")
    slopes = (F.sum(F.col(f"_r{c}") * t) / F.nullif(F.sum(F.col("_rt") * t), F.lit(0.0)) for c in "xy")
    fit = table(r.groupBy(*keys).agg(*(slope.alias(f"_s{c}") for c, slope in zip("xy", slopes, strict=True))), "fit")
    left = _matched(r, fit, keys).select(*keys, "_n", *(F.round(F.col(f"_r{c}") - F.col(f"_s{c}") * F.col("_rt"), 6).alias(f"_l{c}") for c in "xy"))
    return _correlated(left.filter(F.col("_lx").isNotNull()), keys, "_lx", "_ly").select(*keys, "rho")


def mann_whitney(df: DataFrame, keys: list[str], x: str, group: Column) -> DataFrame:
    """U of the rows where group holds against the others, and the one-sided p-value (larger) by the normal approximation with corrections for continuity and ties."""
    rows = df.filter(F.col(x).isNotNull() & group.isNotNull()).select(*keys, F.col(x).alias("_x"), group.cast("int").alias("_g"))
    ranks = value_ranks(rows, keys, "_x", sums={"_n1": F.col("_g")})
    n, ties = F.col("_n").cast("double"), F.sum(F.col("_n").cast("double") * (F.col("_n").cast("double") * F.col("_n") - 1))
    agg = ranks.groupBy(*keys).agg(F.sum(F.col("_n1") * F.col("_rank")).alias("_rs"), F.sum("_n1").alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n2"), ties.alias("_ties"), F.sum(n).alias("_all"))
    u = agg.withColumn("u", F.col("_rs") - F.col("n1") * (F.col("n1") + 1) / 2)
    spread = F.col("_all") + 1 - div(F.col("_ties"), F.col("_all") * (F.col("_all") - 1))
    mean, sd = F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1").cast("double") * F.col("n2") * spread / 12)
    return u.select(*keys, "n1", "n2", "u", (1.0 - normal_cdf((F.col("u") - mean - 0.5) / F.nullif(sd, F.lit(0.0)))).alias("p_value"))


def autocorr(df: DataFrame, keys: list[str], x: str, order: str = "ts", lag: int = 1) -> DataFrame:
    rows = df.withColumn("_l", F.lag(x, lag).over(ordered(keys, order))).filter(F.col("_l").isNotNull() & F.col(x).isNotNull())
    out = rows.groupBy(*keys).agg(F.covar_pop(x, "_l").alias("_c"), (F.stddev_pop(x) * F.stddev_pop("_l")).alias("_s"))
    return out.select(*keys, (F.col("_c") / F.nullif(F.col("_s"), F.lit(0.0))).alias("acf"))


def jarque_bera(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"))
    return out.withColumn("jb", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess") ** 2 / 4))


def compare(df: DataFrame, a: str, b: str, tolerances: list[float]) -> DataFrame:
    """Agreement of two columns: correlation, absolute differences, shares within tolerances.  Zeros mean `missing` there and are left out."""
    rows = df.filter((F.col(a) != 0) & (F.col(b) != 0)).withColumn("_d", F.abs(F.col(a) - F.col(b)))
    r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), r.alias("r"), F.avg("_d").alias("mean_diff"), F.median("_d").alias("median_diff"), F.max("_d").alias("max_diff"), *((100 * F.avg((F.col("_d") <= t).cast("double"))).alias(f"within_{i}") for i, t in enumerate(tolerances)))


#: Published response-surface coefficients of MacKinnon (2010) for one series with a constant: critical values at 1, 5, 10 %.
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
#: MacKinnon (1994) p-value polynomials, below and above the split, and its bounds.
ADF_P = {"split": -1.61, "min": -18.83, "max": 2.74, "low": (2.1659, 1.4412, 0.038269), "high": (1.7339, 0.93202, -0.12745, -0.010368)}


def adf_test(values: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value, lags): Dickey-Fuller with a constant, lags chosen by the Akaike criterion on a common sample."""
    y = np.asarray(values, float)
    y = y[np.isfinite(y)]
    n = len(y)
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    if n < 10 or most < 0 or np.ptp(y) == 0:
        return math.nan, math.nan, 0
    d = np.diff(y)

    def regress(p: int, first: int) -> tuple[float, float, int]:
        target = d[first:]
        cols = [y[first:-1], *(d[first - k : len(d) - k] for k in range(1, p + 1)), np.ones(len(target))]
        x = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = float(((target - x @ beta) ** 2).sum())
        m, k = x.shape
        if m <= k or rss <= 0:
            return math.nan, math.inf, m
        se = math.sqrt(rss / (m - k) * np.linalg.pinv(x.T @ x)[0, 0])
        return float(beta[0]) / se, m * (math.log(2 * math.pi * rss / m) + 1) + 2 * k, m

    best = min(range(most + 1), key=lambda p: regress(p, most)[1])
    stat = regress(best, best)[0]
    if stat > ADF_P["max"] or stat < ADF_P["min"]:
        return stat, float(stat > 0), best
    c = ADF_P["low"] if stat <= ADF_P["split"] else ADF_P["high"]
    z = sum(k * stat**i for i, k in enumerate(c))
    return stat, 0.5 * (1 + math.erf(z / math.sqrt(2))), best


def critical_value(level: str, n: int) -> float:
    return sum(c / n**i for i, c in enumerate(ADF_CRITICAL[level]))


def adf_full(df: DataFrame, keys: list[str], x: str, order: str = "ts") -> DataFrame:
    """statistic, p_value, lags per key.  A series is a group; series are tested in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, p, k = adf_test(pdf.sort_values(order)[x].to_numpy())
        return pdf.iloc[:1][keys].assign(statistic=s, p_value=p, lags=k)

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, order, x).groupBy(*keys).applyInPandas(run, f"{schema}, statistic double, p_value double, lags int")


def adf_rolling(df: DataFrame, n: int, keys: list[str], x: str, order: str = "ts", step: int = 1) -> DataFrame:
    """p_value of the full test over the n rows before each step-th row, carried forward."""
    w = ordered(keys, order).rowsBetween(-n, -1)
    numbered = df.withColumn("_rn", F.row_number().over(ordered(keys, order)) - 1)
    due = (F.col("_rn") >= n) & ((F.col("_rn") - n) % step == 0)
    rows = numbered.withColumn("_w", F.when(due, F.collect_list(x).over(w)))

    @F.pandas_udf("double")
    def p(windows: pd.Series) -> pd.Series:
        return windows.map(lambda v: adf_test(np.asarray(v))[1] if v is not None and len(v) >= 10 else None)

    made = rows.withColumn("_p", p(F.col("_w")))
    made = made.withColumn("_p", F.when(F.isnan("_p"), None).otherwise(F.col("_p")))
    return made.withColumn("p_value", F.last("_p", ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))).select(*df.columns, "p_value")


def profile(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostic profile of a pair over its rolling metrics, with a verdict."""
    out = measured.groupBy(*keys).agg(
        F.median("hurst").alias("hurst_median"), (100 * F.avg((F.col("adf_stat") < -2.86).cast("double"))).alias("adf_pct"), F.avg("correlation").alias("corr_mean"), F.stddev_samp("correlation").alias("corr_std"),
        F.min("correlation").alias("corr_min"), F.median("half_life").alias("hl_median"), F.median("beta").alias("beta_median"), F.stddev_samp("beta").alias("beta_std"),
    )
    return out.withColumn("verdict", F.when((F.col("hurst_median") < 0.5) & (F.col("adf_pct") > 50), "GO").when((F.col("hurst_median") < 0.5) | (F.col("adf_pct") > 25), "WARN").otherwise("KILL"))
