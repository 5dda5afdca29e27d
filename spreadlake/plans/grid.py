"""Parameter grids: axes are tables, a grid is their product, and every stage depends only on its own axes.

The hedge is computed once for each window, the z-score once for each of its windows.  State machines
run once for each distinct set of levels, all of a part in one walk over the bars; time stops come behind.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import dollar_neutral
from ..operators import rolling, signals, trades, validation


PART = 512


def axes(spark: SparkSession, **values: list) -> DataFrame:
    """The product of the axes with i_<axis>, each value's position, and config_id."""
    tables = []
    for name, options in values.items():
        kind = "int" if all(isinstance(v, int) for v in options) else "double"
        tables.append(spark.createDataFrame([(i, v if kind == "int" else float(v)) for i, v in enumerate(options)], f"i_{name} int, {name} {kind}"))
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)
    number, size = F.lit(0).cast("bigint"), 1
    for name, options in reversed(values.items()):
        number, size = number + F.col(f"i_{name}") * size, size * len(options)
    return grid.withColumn("config_id", number)


def hedges(aligned: DataFrame, windows: list[int], z_windows: list[int], keys: list[str], order: str = "bar_idx") -> DataFrame:
    """aligned once for each pair of windows, with its hedge and z-score, in columns window and z_window.

    The hedge of a window is one plan; its z-windows are further columns of it, unpivoted at the end.
    """
    parts = []
    for w in windows:
        scored = rolling.rolling_ols_windows(aligned, w, z_windows, keys, order, index=order if order == "bar_idx" else None)
        each = F.explode(F.array(*(F.struct(F.lit(z).alias("z_window"), F.col(f"_z{z}").alias("zscore")) for z in z_windows)))
        wide = scored.withColumn("_each", each)
        parts.append(wide.select(*(c for c in scored.columns if not c.startswith("_z")), F.col("_each.zscore").alias("zscore"), F.lit(w).alias("window"), F.col("_each.z_window").alias("z_window")))
    return reduce(DataFrame.unionByName, parts)


def runs_of(z: np.ndarray, entry: np.ndarray, leave: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """(configuration, first bar, first bar behind, side) of the positions of every configuration's state machine, all walked at once; len(z) behind the last bar."""
    state = np.zeros(len(entry), np.int8)  # 1 long, -1 short, 2 cooling down
    since = np.zeros(len(entry), np.int64)
    out: list[tuple[np.ndarray, ...]] = []

    def close(which: np.ndarray, at: int) -> None:
        if len(which):
            out.append((which, since[which].copy(), np.full(len(which), at), state[which].copy()))

    for i, x in enumerate(z.tolist()):
        held = (state == 1) | (state == -1)
        if x != x:
            close(np.flatnonzero(held), i)
            state[:] = 0
            continue
        far = abs(x)
        sign = -1 if x > 0 else 1  # the side that this z-score would open
        if held.any():
            which = np.flatnonzero(held)
            inward = x * state[which]
            left = inward > -leave[which]
            ran = ~left & (inward < -stop[which])
            gone = which[left | ran]
            if len(gone):
                close(gone, i)
                state[which[left]] = 0
                state[which[ran]] = 2
        cool = (state == 2) & ~held & (far < leave)
        opens = (state == 0) & ~held & (far > entry)
        state[cool] = 0
        state[opens] = sign
        since[opens] = i
    close(np.flatnonzero((state == 1) | (state == -1)), len(z))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def run(hedged: DataFrame, configs: DataFrame, keys: list[str], on: list[str] | None = None, order: str = "bar_idx", spec: dict = trades.SPEC, min_trades: int = 0) -> tuple[DataFrame, DataFrame]:
    """(trades, summary) of every configuration: columns entry, leave, stop, and time_stop where there is one.

    Configurations are dealt into parts of about PART distinct (entry, leave, stop); a series meets each
    part once, and one vectorised walk over its bars runs the machines of all its levels.  Time stops
    are applied to the positions that come out.  Positions become trades, prices and sums as columns.
    """
    spark, on = hedged.sparkSession, on or []
    levels = ["entry", "leave", "stop"]
    parts = -(-configs.select(*levels).distinct().count() // PART)
    part = F.pmod(F.xxhash64(*levels), F.lit(max(1, parts))).cast("int")
    small = configs.withColumn("time_stop", F.col("time_stop") if "time_stop" in configs.columns else F.lit(0))
    small = small.select(*on, part.alias("_part"), "config_id", *(F.col(c).cast("double") for c in levels), F.col("time_stop").cast("bigint"))
    group = [*keys, *on, "_part"]
    bars = hedged.select(*keys, *on, order, "ts", "close_a", "close_b", "beta", "zscore").crossJoin(F.broadcast(spark.range(max(1, parts)).select(F.col("id").cast("int").alias("_part"))))
    told = small.crossJoin(F.broadcast(hedged.select(*keys).distinct()))
    told = told.select(*(F.col(c).alias(c) for c in told.columns))  # columns of their own for the cogroup
    kind = {c: hedged.schema[c].dataType.simpleString() for c in [*keys, *on, order, "ts"]}
    fields = [("entry_bar", kind[order]), ("exit_bar", kind[order]), ("entry_time", kind["ts"]), ("exit_time", kind["ts"]), ("side", "int"), *((c, "double") for c in ("raw_entry_a", "raw_entry_b", "raw_exit_a", "raw_exit_b", "beta"))]

    def walk(series: pa.Table, grid: pa.Table) -> pa.Table:
        series = series.sort_by(order)
        n = series.num_rows
        level = np.stack([grid.column(c).to_numpy() for c in levels], 1).reshape(-1, 3)
        distinct, which = np.unique(level, axis=0, return_inverse=True)
        z = series.column("zscore").to_numpy().astype(float) if n else np.zeros(0)
        config, first, behind, side = runs_of(z, *distinct.T)
        by = np.argsort(config, kind="stable")
        config, first, behind, side = config[by], first[by], behind[by], side[by]
        at = np.searchsorted(config, np.arange(len(distinct) + 1))
        size = np.diff(at)[which.reshape(-1)] if len(which) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(level)), size)  # the grid's row of every trade
        pick = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[which.reshape(-1)], size)
        most = grid.column("time_stop").to_numpy()[row]
        exit_ = np.where(most > 0, np.minimum(behind[pick], first[pick] + most), behind[pick])
        done = exit_ < n
        row, pick, exit_ = row[done], pick[done], exit_[done]
        enter = pa.array(first[pick])
        leave = pa.array(exit_)
        take = lambda c, i: series.column(c).take(i)
        columns = [pa.chunked_array([grid.column(c).combine_chunks().take(pa.array(row))]) if grid.num_rows else grid.column(c) for c in [*keys, *on, "config_id"]]
        columns += [take(order, enter), take(order, leave), take("ts", enter), take("ts", leave), pa.chunked_array([pa.array(side[pick], pa.int32())])]
        columns += [take(c, i).cast(pa.float64()) for c, i in (("close_a", enter), ("close_b", enter), ("close_a", leave), ("close_b", leave), ("beta", enter))]
        return pa.table(columns, names=[*keys, *on, "config_id", *(f for f, _ in fields)])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in [*keys, *on]), "config_id bigint", *(f"{f} {t}" for f, t in fields)])
    raw = bars.groupBy(*group).cogroup(told.groupBy(*group)).applyInArrow(walk, schema)
    n_b = dollar_neutral(F.col("raw_entry_a"), spec["mult_a"], F.col("raw_entry_b"), spec["mult_b"], F.col("beta"), F.lit(1))
    done = trades.price(raw.withColumns({"n_a": F.lit(1), "n_b": n_b}), spec)
    summary = trades.summary(done, [*keys, "config_id"]).filter(F.col("trades") >= min_trades)
    return done, summary.join(configs, "config_id")


def axis_summary(grid: DataFrame, axis: str, metric: str = "pnl") -> DataFrame:
    return grid.groupBy(axis).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.max(metric).alias("best"))


def heatmap(grid: DataFrame, rows: str, columns: str, values: list, metric: str = "pnl") -> DataFrame:
    return grid.groupBy(rows).pivot(columns, values).agg(F.median(metric))


def tiers(grid: DataFrame) -> DataFrame:
    """tier of every configuration: the first cascade that it passes."""
    good = (F.col("profit_factor") >= 1.3) & (F.col("trades") >= 20)
    return grid.withColumn("tier", F.when(good & (F.col("win_rate") >= 60), "A").when(good, "B").when(F.col("profit_factor") > 1, "C").otherwise("D"))


def composite(grid: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score: weighted sum of min-max scaled metrics; scales come from one aggregation that is joined back."""
    bounds = grid.agg(*(f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))))
    joined = grid.crossJoin(F.broadcast(bounds))
    score = sum((w * F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return joined.withColumn("score", score).select(*grid.columns, "score")


def best_of(grid: DataFrame, keys: list[str], metric: str = "pnl", tie: str = "config_id", k: int = 1) -> DataFrame:
    """The k best rows of each key, ties by tie."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(metric), tie)
    return grid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def diverse_best(grid: DataFrame, pattern: list[str], same: list[str], n: int, metric: str = "pnl", tie: str = "config_id") -> DataFrame:
    """n rows (a top-n report): the best of each pattern, best patterns first; where there are fewer patterns, the best of
    further values of `same`, each once and none that is there already."""
    first = best_of(grid, pattern, metric, tie).orderBy(F.desc(metric), tie).limit(n)
    fill = best_of(grid, same, metric, tie).join(first.select(*same), same, "left_anti")
    both = first.withColumn("_turn", F.lit(0)).unionByName(fill.withColumn("_turn", F.lit(1)))
    return both.orderBy("_turn", F.desc(metric), tie).limit(n).drop("_turn")


def cross_validated(done: DataFrame, summary: DataFrame, n_bars: int, keys: list[str], **options) -> DataFrame:
    found = validation.cpcv_summary(validation.cpcv_paths(done, n_bars, [*keys, "config_id"], **options), [*keys, "config_id"])
    return summary.join(found, [*keys, "config_id"], "left")
