"""Rolling statistics over rows of a key, in time order.

A frame gives a value only when all its rows hold one: missing and non-finite values are counted, never
summed, so they void the frames that hold them and no others.  All frames take one path: a series is cut into
blocks of rows, each with the rows before it that its frames reach back to (its halo), and in a block frames are
differences of running sums of values about the block's mean.  So the cost doesn't grow with the frame, the
error doesn't grow with the series, and one series spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import div
from .walk import in_order

BLOCK = 4096
NOISE = 2e-15  # of the running sum of squares: what is left of a sum of squares below that is rounding


def ordered(keys: list[str], order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(F.abs(x) < float("inf"), x)  # NaN counts as larger than all numbers


def numbered(df: DataFrame, keys: list[str], order: str = "ts", out: str = "_rn", unit: str = "month") -> DataFrame:
    """df with the number of each row of its key, from 0.

    A time order is counted by units of time: a window is one of a key and unit, and what lies before a unit
    comes from a table of one row a key and unit.  Other orders are numbered in one window a key.
    """
    if not isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(out, F.row_number().over(ordered(keys, order)).cast("long") - 1)
    cut = df.withColumn("_unit", F.date_trunc(unit, F.col(order).cast("timestamp")))
    counts = cut.groupBy(*keys, "_unit").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(ordered(keys, "_unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_unit").alias("_u"), before.alias("_before"))
    same = F.col("_unit").eqNullSafe(F.col("_u"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(ordered([*keys, "_unit"], order)) - 1
    return cut.withColumn(out, inside).join(starts, same).withColumn(out, F.col("_before") + F.col(out)).select(*df.columns, out)


def blocked(df: DataFrame, keys: list[str], order: str, halo: int, make: Callable[[DataFrame, list[str]], DataFrame], index: str | None = None) -> DataFrame:
    """make(rows, keys) on blocks of rows, each with at least the `halo` rows before it; df's rows once, with make's columns.

    index: a column that numbers the rows of a key from 0 without gaps (such as bar_idx of aligned legs);
    without one they are numbered first.  make finds that number in _rn.
    """
    size = max(BLOCK, 4 * halo)
    rows = df.withColumn("_rn", F.col(index).cast("long")) if index else numbered(df, keys, order)
    own = F.expr(f"_rn div {size}")
    copies = F.when(F.col("_rn") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_block", F.explode(copies)).withColumn("_own", own == F.col("_block"))
    return make(dealt, [*keys, "_block"]).filter("_own")


HELPERS = ("_rn", "_block", "_own")


def _held(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """df, made by blocked(), with the last value that is not NULL of each column carried forward, over blocks, too.

    A walker fills each block; what the blocks before end with comes from a table of one row a block.  Both read
    one exchange, so what is above it runs once.
    """
    at = [*keys, "_block"]

    def start():
        last: dict[str, pa.Scalar] = {}

        def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            for c in columns:
                cols[c] = pc.fill_null_forward(cols[c])
                if c in last:
                    cols[c] = pc.fill_null(cols[c], last[c])
                if cols[c][-1].is_valid:
                    last[c] = cols[c][-1]
            return pa.RecordBatch.from_arrays(list(cols.values()), batch.schema.names)

        return walk

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    filled = in_order(df, at, [order], start, schema)
    ends = filled.groupBy(*at).agg(*(F.max_by(c, order).alias(f"_e_{c}") for c in columns))
    upto = ordered(keys, "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*at, *(F.last(f"_e_{c}", ignorenulls=True).over(upto).alias(f"_b_{c}") for c in columns))
    joined = filled.join(before, at, "left")
    return joined.withColumns({c: F.coalesce(c, f"_b_{c}") for c in columns}).drop(*(f"_b_{c}" for c in columns))


def framed(df: DataFrame, terms: dict[str, Column], sizes: dict[str, int], keys: list[str], order: str = "ts", end: int = 0) -> DataFrame:
    """df with the sum of each term over a frame of its size that ends `end` rows from the row (0 or -1), as differences
    of running sums, which stay in <term>_run."""
    at = ordered(keys, order)
    running = at.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumns({f"{k}_run": F.sum(F.coalesce(v, F.lit(0))).over(running) for k, v in terms.items()})
    here = lambda k: F.col(f"{k}_run") if end == 0 else F.lag(f"{k}_run", -end).over(at)
    return summed.withColumns({k: F.coalesce(here(k), F.lit(0)) - F.coalesce(F.lag(f"{k}_run", sizes[k] - end).over(at), F.lit(0)) for k in terms})


def _spread_of(sum_sq: Column, total: Column, n, run: Column) -> Column:
    """Sum of squares about the mean of a frame; 0 where only rounding is left."""
    q = sum_sq - total * total / n
    return F.when(q > NOISE * run, q).otherwise(F.when(q.isNotNull(), 0.0))


def _moments(df: DataFrame, x: str, y: str | None, n: int, keys: list[str], order: str, prefix: str) -> DataFrame:
    names = [x] if y is None else [x, y]
    clean = df.withColumns({f"_v{i}": finite(F.col(c)) for i, c in enumerate(names)})
    both = F.lit(True)
    for i in range(len(names)):
        both = both & F.col(f"_v{i}").isNotNull()
    whole = Window.partitionBy(*keys)
    clean = clean.withColumns({f"_mean{i}": F.avg(f"_v{i}").over(whole) for i in range(len(names))})
    about = clean.withColumns({f"_c{i}": F.when(both, F.col(f"_v{i}") - F.col(f"_mean{i}")) for i in range(len(names))})
    terms = {"_fn": F.when(both, 1).otherwise(0)}
    for i in range(len(names)):
        terms |= {f"_f{i}": F.col(f"_c{i}"), f"_f{i}{i}": F.col(f"_c{i}") * F.col(f"_c{i}")}
    if y is not None:
        terms["_f01"] = F.col("_c0") * F.col("_c1")
    cut = framed(about, terms, dict.fromkeys(terms, n), keys, order)
    got = F.col("_fn") == n
    out = {}
    for i, c in enumerate(names):
        out[f"{prefix}mean_{c}"] = F.when(got, F.col(f"_mean{i}") + F.col(f"_f{i}") / n)
        out[f"{prefix}var_{c}"] = F.when(got, _spread_of(F.col(f"_f{i}{i}"), F.col(f"_f{i}"), n, F.col(f"_f{i}{i}_run")) / (n - 1))
    if y is not None:
        out[f"{prefix}cov"] = F.when(got, (F.col("_f01") - F.col("_f0") * F.col("_f1") / n) / (n - 1))
    return cut.withColumns(out).select(*df.columns, *out)


def moments(df: DataFrame, x: str, y: str | None, n: int, keys: list[str], order: str = "ts", prefix: str = "m_", index: str | None = None) -> DataFrame:
    """df with mean_x, var_x (and mean_y, var_y, cov) of the last n rows, names behind prefix; NULL unless all n rows hold finite values."""
    return blocked(df, keys, order, n, lambda d, k: _moments(d, x, y, n, k, order, prefix), index).drop(*HELPERS)


def _ols(df: DataFrame, window: int, z_window: int, keys: list[str], order: str, null_z: str) -> DataFrame:
    logs = df.withColumns({"la": finite(F.ln("close_a")), "lb": finite(F.ln("close_b"))})
    m = _moments(logs, "la", "lb", window, keys, order, "m_")
    beta = div(F.col("m_cov"), F.col("m_var_lb"))
    out = m.withColumn("beta", beta).withColumn("alpha", F.col("m_mean_la") - F.col("beta") * F.col("m_mean_lb"))
    out = out.withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))
    return _z(out.select(*logs.columns, "beta", "alpha", "spread"), z_window, keys, order, "spread", "zscore", null_z)


def rolling_ols(df: DataFrame, window: int, z_window: int, keys: list[str], order: str = "ts", null_z: str = "null", index: str | None = None) -> DataFrame:
    """beta, alpha, spread and z-score of log prices (close_a on close_b).  null_z: `null` keeps a missing z, `zero` makes it 0."""
    return blocked(df, keys, order, window + z_window, lambda d, k: _ols(d, window, z_window, k, order, null_z), index).drop(*HELPERS)


def rolling_ols_windows(df: DataFrame, window: int, z_windows: list[int], keys: list[str], order: str = "ts", index: str | None = None) -> DataFrame:
    """As rolling_ols, with a z-score for each of the z_windows, in _z<window>; one set of blocks serves all."""

    def make(d: DataFrame, k: list[str]) -> DataFrame:
        out = _ols(d, window, z_windows[0], k, order, "null").withColumnRenamed("zscore", f"_z{z_windows[0]}")
        for z in z_windows[1:]:
            out = _z(out, z, k, order, "spread", f"_z{z}", "null")
        return out

    return blocked(df, keys, order, window + max(z_windows), make, index).drop(*HELPERS)


def _z(df: DataFrame, n: int, keys: list[str], order: str, x: str, out: str, null_z: str) -> DataFrame:
    m = _moments(df, x, None, n, keys, order, "_z_")
    z = div(F.col(x) - F.col(f"_z_mean_{x}"), F.sqrt(F.col(f"_z_var_{x}")))
    return m.withColumn(out, F.coalesce(z, F.lit(0.0)) if null_z == "zero" else z).select(*df.columns, out)


def rolling_z(df: DataFrame, n: int, keys: list[str], order: str = "ts", x: str = "spread", out: str = "zscore", null_z: str = "null", index: str | None = None) -> DataFrame:
    return blocked(df, keys, order, n, lambda d, k: _z(d, n, k, order, x, out, null_z), index).drop(*HELPERS)


def _corr(df: DataFrame, n: int, keys: list[str], order: str, x: str, y: str, out: str) -> DataFrame:
    m = _moments(df, x, y, n, keys, order, "_c_")
    return m.withColumn(out, div(F.col("_c_cov"), F.sqrt(F.col(f"_c_var_{x}") * F.col(f"_c_var_{y}")))).select(*df.columns, out)


def rolling_corr(df: DataFrame, n: int, keys: list[str], order: str = "ts", x: str = "la", y: str = "lb", out: str = "correlation", index: str | None = None) -> DataFrame:
    return blocked(df, keys, order, n, lambda d, k: _corr(d, n, k, order, x, y, out), index).drop(*HELPERS)


def every(value: Column, n: int, step: int) -> Column:
    """value on every step-th row of a series from row n on (rows made by blocked())."""
    return F.when((F.col("_rn") >= n) & ((F.col("_rn") - n) % step == 0), value)


def ffill(value: Column, keys: list[str], order: str = "ts", most: int | None = None) -> Column:
    lo = Window.unboundedPreceding if most is None else -most
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(lo, 0))


def _adf(df: DataFrame, n: int, keys: list[str], order: str, x: str, step: int, current: bool, out: str) -> DataFrame:
    at = ordered(keys, order)
    clean = df.withColumn("_x", finite(F.col(x)))
    level = F.avg("_x").over(Window.partitionBy(*keys))  # the statistic does not change with the level, its sums of squares do
    d, lagged = F.col("_x") - F.lag("_x").over(at), F.lag("_x").over(at)
    pairs = clean.withColumns({"_d": d, "_l": F.when(d.isNotNull(), lagged - level)})
    terms = {"_c": F.col("_d").isNotNull().cast("int"), "_sd": F.col("_d"), "_sl": F.col("_l"), "_sdl": F.col("_d") * F.col("_l"), "_sll": F.col("_l") * F.col("_l"), "_sdd": F.col("_d") * F.col("_d")}
    cut = framed(pairs, terms, dict.fromkeys(terms, n - 1), keys, order, 0 if current else -1)
    some = F.nullif(F.col("_c"), F.lit(0))
    sxx = _spread_of(F.col("_sll"), F.col("_sl"), some, F.col("_sll_run"))
    syy = _spread_of(F.col("_sdd"), F.col("_sd"), some, F.col("_sdd_run"))
    sums = cut.withColumns({"_sxx": F.when(sxx > 0, sxx), "_sxy": F.col("_sdl") - F.col("_sd") * F.col("_sl") / some, "_syy": syy})
    gamma = F.col("_sxy") / F.col("_sxx")
    var = (F.col("_syy") - gamma * F.col("_sxy")) / F.nullif(F.col("_c") - 2, F.lit(0))
    stat = F.when((F.col("_c") >= 10) & (var > 0), gamma / F.sqrt(F.when(var > 0, var) / F.col("_sxx")))
    return sums.withColumn(out, every(stat, n, step)).select(*df.columns, out)


def rolling_adf(df: DataFrame, n: int, keys: list[str], order: str = "ts", x: str = "spread", step: int = 1, current: bool = False, out: str = "adf_stat", index: str | None = None) -> DataFrame:
    """Dickey-Fuller statistic without lags over n - 1 pairs; they end before the row, or at it (current)."""
    made = blocked(df, keys, order, n + 2, lambda d, k: _adf(d, n, k, order, x, step, current, out), index)
    return (_held(made, [out], keys, order) if step > 1 else made).drop(*HELPERS)


def hurst_lags(n: int, most: int = 50) -> list[int]:
    return list(range(2, min(n // 4, most) + 1))


def _slope(x: list[float], y: list[Column], at_least: int = 3) -> Column:
    """Least-squares slope of the y that are not null on their x."""
    has = [v.isNotNull() for v in y]
    add = lambda parts: sum(parts[1:], parts[0])
    n = add([F.when(h, 1.0).otherwise(0.0) for h in has])
    sx = add([F.when(h, v).otherwise(0.0) for h, v in zip(has, x, strict=True)])
    sxx = add([F.when(h, v * v).otherwise(0.0) for h, v in zip(has, x, strict=True)])
    sy = add([F.coalesce(v, F.lit(0.0)) for v in y])
    sxy = add([F.coalesce(v * k, F.lit(0.0)) for v, k in zip(y, x, strict=True)])
    return F.when(n >= at_least, div(n * sxy - sx * sy, n * sxx - sx * sx))


def hurst_of(v: np.ndarray, n: int) -> np.ndarray:
    """Raw exponent of the n values up to each place (NaN where one is missing): slope of ln of the deviation of lagged differences on ln of the lag."""
    lags = hurst_lags(n)
    v = np.where(np.isfinite(v), v, np.nan)
    if len(v) < n or np.isnan(v).all():
        return np.full(len(v), np.nan)
    whole = np.convolve(np.isnan(v), np.ones(n, int))[n - 1 : len(v)] == 0  # frames without a gap, from place n - 1 on
    v = v - np.nanmean(v)
    y = np.full((len(lags), len(whole)), np.nan)
    for i, k in enumerate(lags):
        d = np.nan_to_num(v[k:] - v[:-k])  # the difference that ends at place j is d[j - k]
        sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
        m = n - k
        total, sq = sums[m:] - sums[:-m], squares[m:] - squares[:-m]
        var = sq - total * total / m
        var = np.where(var > NOISE * squares[m:], var, 0.0) / (m - 1)
        with np.errstate(divide="ignore"):
            y[i] = np.where(whole & (np.sqrt(var) > 1e-12), np.log(np.sqrt(var)), np.nan)
    x, has = np.log(lags)[:, None], ~np.isnan(y)
    count, sx, sxx = has.sum(0), (has * x).sum(0), (has * x * x).sum(0)
    sy, sxy = np.nan_to_num(y).sum(0), (np.nan_to_num(y) * x).sum(0)
    below = count * sxx - sx * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where((count >= 3) & (below != 0), (count * sxy - sx * sy) / below, np.nan)
    return np.concatenate([np.full(n - 1, np.nan), slope])


def _hurst(df: DataFrame, n: int, keys: list[str], order: str, x: str, step: int, out: str) -> DataFrame:
    """Values on their own rows, not carried forward; a block (of bounded size) at a time."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t[order]))
        raw = hurst_of(t[x].to_numpy().astype(float), n)
        rn = t["_rn"].to_numpy()
        due = (rn >= n) & ((rn - n) % step == 0) & ~np.isnan(raw)
        return t.append_column(out, pa.array(np.clip(raw, 0.01, 0.99), mask=~due))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInArrow(run, f"{schema}, `{out}` double")


def rolling_hurst(df: DataFrame, n: int, keys: list[str], order: str = "ts", x: str = "spread", step: int = 1, out: str = "hurst", index: str | None = None) -> DataFrame:
    """Hurst exponent from the growth of the spread's lagged differences, kept in 0.01 to 0.99, carried forward."""
    if len(hurst_lags(n)) < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    made = blocked(df, keys, order, n + 2, lambda d, k: _hurst(d, n, k, order, x, step, out), index)
    return _held(made, [out], keys, order).drop(*HELPERS)


def _halflife(df: DataFrame, n: int, keys: list[str], order: str, x: str, step: int, out: str) -> DataFrame:
    """Values on their own rows, not carried forward."""
    lagged = df.withColumn("_l", F.lag(x).over(ordered(keys, order)))
    m = _moments(lagged, x, "_l", n - 1, keys, order, "_h_")
    made = m.withColumn("_b", div(F.col("_h_cov"), F.col("_h_var__l")))
    ok = (F.col("_b") > 0) & (F.col("_b") < 1)
    return made.withColumn(out, every(F.when(ok, -math.log(2) / F.ln(F.when(ok, F.col("_b")))), 0, step)).select(*df.columns, out)


def rolling_halflife(df: DataFrame, n: int, keys: list[str], order: str = "ts", x: str = "spread", step: int = 1, out: str = "half_life", index: str | None = None) -> DataFrame:
    """-ln 2 / ln b of the lag-one regression coefficient b in (0, 1), carried forward."""
    made = blocked(df, keys, order, n + 2, lambda d, k: _halflife(d, n, k, order, x, step, out), index)
    return _held(made, [out], keys, order).drop(*HELPERS)


def all_metrics(df: DataFrame, keys: list[str], order: str = "ts", adf: int = 24, hurst: int = 64, halflife: int = 24, corr: int = 12, step: int = 1, index: str | None = None) -> DataFrame:
    """adf_stat, hurst, half_life and correlation, all from one set of blocks."""

    def make(d: DataFrame, k: list[str]) -> DataFrame:
        out = _adf(d, adf, k, order, "spread", step, False, "adf_stat")
        out = _corr(_halflife(out, halflife, k, order, "spread", step, "half_life"), corr, k, order, "la", "lb", "correlation")
        return _hurst(out, hurst, k, order, "spread", step, "hurst") if len(hurst_lags(hurst)) > 1 else out.withColumn("hurst", F.lit(None).cast("double"))

    made = blocked(df, keys, order, max(adf, hurst, halflife, corr) + 2, make, index)
    return _held(made, ["hurst", "half_life", *(["adf_stat"] if step > 1 else [])], keys, order).drop(*HELPERS).select(*df.columns, "adf_stat", "hurst", "half_life", "correlation")
