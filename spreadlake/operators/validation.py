"""Validation: cross-validation paths, neighborhoods, account limits, walk-forward, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import deflated_sharpe, dollar_neutral, expected_max_sharpe
from .rolling import ordered


def folds(spark: SparkSession, n_bars: int, n_folds: int = 10) -> DataFrame:
    """fold, lo, hi (exclusive); the last fold has the remainder."""
    size = n_bars // n_folds
    return spark.range(n_folds).select(F.col("id").cast("int").alias("fold"), (F.col("id") * size).alias("lo"), F.when(F.col("id") == n_folds - 1, n_bars).otherwise((F.col("id") + 1) * size).alias("hi"))


def paths(spark: SparkSession, n_folds: int = 10, n_test: int = 2) -> DataFrame:
    """path, fold: the combinations of test folds in lexicographic order."""
    rows = [(i, f) for i, c in enumerate(combinations(range(n_folds), n_test)) for f in c]
    return spark.createDataFrame(rows, "path int, fold int")


def cpcv_paths(trades: DataFrame, n_bars: int, keys: list[str], n_folds: int = 10, n_test: int = 2, purge: int = 100, min_trades: int = 5) -> DataFrame:
    """Sharpe (mean over population deviation of trade PnL) of each path, over trades whose entry and exit are in purged test folds.

    Paths are a table of fixed size that is broadcast; trades are joined to folds first, so a trade meets
    only the paths that test its folds.
    """
    spark = trades.sparkSession
    f = folds(spark, n_bars, n_folds).select("fold", (F.col("lo") + purge).alias("lo"), (F.col("hi") - purge).alias("hi"))
    fold_of = lambda bar: F.least(F.floor(F.col(bar) / (n_bars // n_folds)), F.lit(n_folds - 1)).cast("int")
    t = trades.select(*keys, "entry_bar", "exit_bar", "pnl_net", fold_of("entry_bar").alias("ef"), fold_of("exit_bar").alias("xf"))
    inside = F.broadcast(f)
    t = t.join(inside.withColumnsRenamed({"fold": "ef", "lo": "elo", "hi": "ehi"}), "ef").filter((F.col("entry_bar") >= F.col("elo")) & (F.col("entry_bar") < F.col("ehi")))
    t = t.join(inside.withColumnsRenamed({"fold": "xf", "lo": "xlo", "hi": "xhi"}), "xf").filter((F.col("exit_bar") >= F.col("xlo")) & (F.col("exit_bar") < F.col("xhi")))
    p = F.broadcast(paths(spark, n_folds, n_test))
    met = t.join(p.withColumnRenamed("fold", "ef"), "ef").join(p.withColumnsRenamed({"fold": "xf", "path": "path2"}), "xf").filter("path = path2")
    std = F.stddev_pop("pnl_net")
    sharpe = F.when((F.count("*") < 2) | (std < 1e-12), 0.0).otherwise(F.avg("pnl_net") / F.nullif(std, F.lit(0.0)))
    got = met.groupBy(*keys, "path").agg(F.count("*").alias("n"), sharpe.alias("sharpe"))
    return got.filter(F.col("n") >= min_trades)


def cpcv_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("sharpe")
    return found.groupBy(*keys).agg(F.median(s).alias("median_sharpe"), F.avg(s).alias("mean_sharpe"), F.stddev_pop(s).alias("std_sharpe"), F.min(s).alias("min_sharpe"), (100 * F.avg((s > 0).cast("double"))).alias("pct_positive"), F.count("*").alias("valid_paths"))


def deflated(trades: DataFrame, keys: list[str], n_trials: int, mean_sharpe: float, std_sharpe: float) -> DataFrame:
    p = F.col("pnl_net")
    agg = trades.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(p) / F.nullif(F.stddev_pop(p), F.lit(0.0))).alias("sharpe"), F.skewness(p).alias("skew"), (F.kurtosis(p) + 3).alias("kurt"))
    sr0 = expected_max_sharpe(F.lit(float(n_trials)), F.lit(mean_sharpe), F.lit(std_sharpe))
    return agg.withColumn("benchmark", sr0).withColumn("dsr", deflated_sharpe(F.col("sharpe"), F.col("benchmark"), F.col("n"), F.col("skew"), F.col("kurt")))


def neighbors(grid: DataFrame, axes: list[str]) -> DataFrame:
    """Pairs of a grid point and those one step away on one axis; axes hold integer positions, so no floats are compared."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(d).alias("step")) for a in axes for d in (-1, 1))))
    moved = grid.select(*(F.col(a).alias(f"c_{a}") for a in axes), moves.alias("_m"))
    moved = moved.select("*", *((F.col(f"c_{a}") + F.when(F.col("_m.axis") == a, F.col("_m.step")).otherwise(0)).alias(a) for a in axes)).drop("_m")
    return moved.join(grid, axes)


def robustness(grid: DataFrame, axes: list[str], metric: str, min_share: float = 60.0, max_drop: float = 50.0) -> DataFrame:
    """Per point: its neighbors' share with metric > 1, the drop of their mean, and robust or not."""
    around = neighbors(grid.select(*axes, metric), axes).groupBy(*(f"c_{a}" for a in axes)).agg(F.count("*").alias("neighbors"), (100 * F.avg((F.col(metric) > 1).cast("double"))).alias("pct_good"), F.avg(metric).alias("_mean"))
    joined = grid.select(*axes, metric).join(around.withColumnsRenamed({f"c_{a}": a for a in axes}), axes)
    drop = 100 * (F.col(metric) - F.col("_mean")) / F.nullif(F.col(metric), F.lit(0.0))
    return joined.select(*axes, metric, "neighbors", "pct_good", drop.alias("degradation"), ((F.col("pct_good") >= min_share) & (F.coalesce(drop, F.lit(0.0)) < max_drop)).alias("robust"))


def daily_pnl(trades: DataFrame, keys: list[str], by: str = "exit_time") -> DataFrame:
    return trades.groupBy(*keys, F.to_date(by).alias("day")).agg(F.sum("pnl_net").alias("pnl"), F.count("*").alias("trades"))


def account_limits(trades: DataFrame, curve: DataFrame, keys: list[str], daily_loss: float = 4500.0, trailing: float = 5000.0, order: str = "bar_idx") -> DataFrame:
    """Worst day, worst drawdown from the running peak, breaches, and whether the account stays open (a limit met exactly is kept)."""
    days = daily_pnl(trades, keys).groupBy(*keys).agg(F.min("pnl").alias("worst_day"), F.count_if(F.col("pnl") < -daily_loss).alias("days_over_loss"))
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    dd = curve.withColumn("_dd", F.col("equity") - F.max("equity").over(w)).groupBy(*keys).agg(F.min("_dd").alias("worst_drawdown"), F.count_if(F.col("_dd") < -trailing).alias("bars_over_drawdown"))
    return days.join(dd, keys).withColumn("compliant", (F.col("days_over_loss") == 0) & (F.col("bars_over_drawdown") == 0))


def walk_forward(trades: DataFrame, n_bars: int, keys: list[str], in_sample: int, out_sample: int, step: int, least: int = 3) -> DataFrame:
    """Every fold of every key with its out-of-sample trades: n, pnl and profit factor (0 without losses).

    GO asks for a profit factor over 1 and `least` trades; a fold without trades is no GO.
    """
    spark = trades.sparkSession
    n = max(0, (n_bars - in_sample - out_sample) // step + 1)
    f = F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("fold"), (F.col("id") * step + in_sample).alias("lo"), (F.col("id") * step + in_sample + out_sample).alias("hi")))
    # folds lie a step apart, so the ones that a trade may be in follow from its entry
    last = F.floor((F.col("entry_bar") - in_sample) / step).cast("int")
    first = F.greatest(F.lit(0), last - (out_sample - 1) // step)
    near = trades.filter(F.col("entry_bar") >= in_sample).withColumn("fold", F.explode(F.sequence(first, last)))
    met = near.join(f, "fold").filter((F.col("entry_bar") >= F.col("lo")) & (F.col("exit_bar") <= F.col("hi")))
    pnl = F.col("pnl_net")
    got = met.groupBy(*keys, "fold").agg(F.count("*").alias("_n"), F.sum(pnl).alias("_pnl"), F.sum(F.when(pnl > 0, pnl)).alias("_won"), F.sum(F.when(pnl < 0, -pnl)).alias("_lost"))
    every = trades.select(*keys).distinct().crossJoin(f.select("fold")).join(got, [*keys, "fold"], "left")
    factor = F.when(F.col("_lost") > 0, F.coalesce("_won", F.lit(0.0)) / F.nullif(F.col("_lost"), F.lit(0.0))).otherwise(0.0)
    out = every.select(*keys, "fold", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_pnl", F.lit(0.0)).alias("pnl"), factor.alias("profit_factor"))
    return out.withColumn("go", (F.col("profit_factor") > 1) & (F.col("n") >= least))


def recency(found: DataFrame, keys: list[str], last: int = 6) -> DataFrame:
    """The share of GO among the last folds."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fold")))
    return found.withColumn("_n", nth).filter(F.col("_n") <= last).groupBy(*keys).agg((100 * F.avg(F.col("go").cast("double"))).alias("pct_go"), F.count("*").alias("folds"))


TASKS = 32
CELLS = 1 << 21  # numbers of a matrix that a task works on at a time
WORD, MIX, STEP, SEED_STEP = 0xFFFFFFFF, 73244475, 10368889, 2654435


def stream(sims: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """32 random bits for each simulation (a row) and place: a function of simulation, place and seed alone, so no
    number depends on how simulations are dealt to tasks."""

    def mixed(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & np.uint64(WORD)
        return x ^ (x >> np.uint64(16))

    own = mixed((sims.astype(np.uint64) + np.uint64(seed * SEED_STEP)) & np.uint64(WORD))
    return mixed((own[:, None] + at.astype(np.uint64)[None, :] * np.uint64(STEP)) & np.uint64(WORD)).astype(np.uint32)


def resampled(rows: DataFrame, values: list[str], order: str, n_sims: int, keys: list[str], simulate: Callable[[np.ndarray, dict[str, np.ndarray]], list[np.ndarray]], out: str, first: int = 0) -> DataFrame:
    """keys, sim and the columns of out for the simulations first to n_sims - 1 of each key.

    A key's rows (the trades of a back-test, or the bars of a series: they must fit a worker) are packed once, in
    order, and go to TASKS tasks with a share of the simulations each; simulate(sims, columns) works on as many
    simulations at a time as have CELLS values.
    """
    spark = rows.sparkSession
    taken = rows.select(*keys, F.struct(F.col(order).alias("_o"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values))).alias("_s"))
    whole = taken.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    part = -(-(n_sims - first) // TASKS)
    dealt = whole.crossJoin(F.broadcast(spark.range(TASKS).select(F.col("id").alias("_task")))).repartition(TASKS, "_task")
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = batch.column("_s")[i].values
                cols = {n: packed.field(j).to_numpy(zero_copy_only=False) for j, n in enumerate([order, *values])}
                task = batch.column("_task")[i].as_py()
                lo, hi = first + task * part, min(n_sims, first + (task + 1) * part)
                step = max(1, CELLS // max(len(packed), 1))
                for at in range(lo, hi, step):
                    sims = np.arange(at, min(hi, at + step), dtype=np.int64)
                    made = [pa.array(x) for x in simulate(sims, cols)]
                    held = [pa.repeat(batch.column(k)[i], len(sims)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(sims), *made], [*keys, "sim", *names])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{kinds}, sim bigint, {out}")


def permutation(measured: DataFrame, metric: str, allowed: Column, n_sims: int, keys: list[str], order: str = "bar_idx", seed: int = 7) -> DataFrame:
    """Back-tests of the signals under a gate on the metric (sim NULL) and on n_sims orders of it: trades, pnl, profit factor.

    The gate delays entries, so every order makes trades of its own: of each run of signals, from the first bar that is
    open to the run's end.  What a trade from each bar of a run would pay is priced once; a simulation picks the bars.
    """
    from . import signals
    from . import trades as t

    at = ordered(keys, order)
    runs = signals.with_runs(measured.withColumn("_ok", F.coalesce(allowed, F.lit(False))), keys, order)
    ahead = runs.withColumns({f"_n{c}": F.lead(f"close_{c}").over(at) for c in "ab"}).withColumn("_more", F.lead(order).over(at).isNotNull())
    whole = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = ahead.withColumns({f"raw_exit_{c}": F.last(f"_n{c}").over(whole) for c in "ab"} | {"_trade": F.col("_run").isNotNull() & F.last("_more").over(whole)})
    size = dollar_neutral(F.col("close_a"), t.SPEC["mult_a"], F.col("close_b"), t.SPEC["mult_b"], F.col("beta"), F.lit(1))
    raw = ended.withColumns({"side": F.col("signal"), "raw_entry_a": F.col("close_a"), "raw_entry_b": F.col("close_b"), "n_a": F.lit(1), "n_b": size})
    bars = t.price(raw).select(*keys, order, "_ok", F.when(F.col("_trade"), F.col("_run")).otherwise(0).alias("_run"), F.coalesce("pnl_net", F.lit(float("nan"))).alias("_pnl"))

    def simulate(sims: np.ndarray, cols: dict[str, np.ndarray]) -> list[np.ndarray]:
        ok, run, pnl = cols["_ok"].astype(bool), cols["_run"], cols["_pnl"]
        inside = np.flatnonzero(run > 0)
        starts = np.flatnonzero(np.append(True, run[inside][1:] != run[inside][:-1])) if len(inside) else inside
        stops = np.append(starts[1:], len(inside))
        trades, total, factor = np.zeros(len(sims), np.int64), np.zeros(len(sims)), np.zeros(len(sims))
        for i, sim in enumerate(sims.tolist()):
            gate = ok if sim < 0 else ok[np.argsort(stream(np.array([sim]), cols[order], seed)[0], kind="stable")]
            met = np.flatnonzero(gate[inside])
            if not len(met):
                continue
            first = np.searchsorted(met, starts)
            taken = met[first[first < len(met)]]
            taken = taken[taken < stops[: len(taken)]]
            paid = pnl[inside[taken]]
            gain, loss = paid[paid > 0].sum(), -paid[paid <= 0].sum()
            trades[i], total[i] = len(taken), np.nansum(paid)
            factor[i] = gain / loss if loss > 0 else np.inf if gain > 0 else 0.0
        return [trades, total, factor]

    found = resampled(bars, ["_ok", "_run", "_pnl"], order, n_sims, keys, simulate, "trades bigint, pnl double, profit_factor double", first=-1)
    return found.withColumn("sim", F.when(F.col("sim") >= 0, F.col("sim")))


def permutation_p(found: DataFrame, keys: list[str]) -> DataFrame:
    """p_value: the share of shuffles with a profit factor at or over the one of the metric as it is."""
    own = F.max(F.when(F.col("sim").isNull(), F.col("profit_factor")))
    ref = found.groupBy(*keys).agg(own.alias("profit_factor"))
    sims = found.filter("sim is not null").withColumnRenamed("profit_factor", "_pf").join(F.broadcast(ref), keys)
    return sims.groupBy(*keys, "profit_factor").agg(F.count("*").alias("sims"), F.avg((F.col("_pf") >= F.col("profit_factor")).cast("double")).alias("p_value"))


def monte_carlo_drawdown(trades: DataFrame, n_sims: int, keys: list[str], seed: int = 42, key: str = "entry_bar") -> DataFrame:
    """max_dd of each of n_sims orders of the trades; an order sorts them by the random stream of simulation and trade."""

    def simulate(sims: np.ndarray, cols: dict[str, np.ndarray]) -> list[np.ndarray]:
        pnl = np.nan_to_num(cols["pnl_net"].astype(float))
        cum = np.cumsum(pnl[np.argsort(stream(sims, cols[key], seed), axis=1, kind="stable")], axis=1)
        return [(cum - np.maximum.accumulate(cum, axis=1)).min(axis=1)]

    return resampled(trades, ["pnl_net"], key, n_sims, keys, simulate, "max_dd double")


def bootstrap(trades: DataFrame, n_sims: int, n_draws: int, target: float, ruin: float, keys: list[str], seed: int = 42, key: str = "entry_bar") -> DataFrame:
    """Draws with replacement until the sum reaches target or ruin: per simulation the outcome and how many trades it took."""

    def simulate(sims: np.ndarray, cols: dict[str, np.ndarray]) -> list[np.ndarray]:
        pnl = np.nan_to_num(cols["pnl_net"].astype(float))
        outcome, took = [], []
        for lo in range(0, len(sims), max(1, CELLS // n_draws)):
            some = sims[lo : lo + max(1, CELLS // n_draws)]
            cum = np.cumsum(pnl[stream(some, np.arange(n_draws), seed) % len(pnl)], axis=1)
            hit = (cum >= target) | (cum <= -ruin)
            first, any_ = hit.argmax(axis=1), hit.any(axis=1)
            at = cum[np.arange(len(some)), first]
            outcome.append(np.where(any_, np.where(at >= target, "target", "ruin"), "open"))
            took.append(np.where(any_, first + 1, n_draws).astype(np.int64))
        return [np.concatenate(outcome).astype(object), np.concatenate(took)]

    return resampled(trades, ["pnl_net"], key, n_sims, keys, simulate, "outcome string, trades bigint")


def slippage_sweep(raw: DataFrame, keys: list[str], spec: dict, most: int = 3) -> DataFrame:
    """Summaries of the same trades under 0 to `most` ticks of slippage."""
    from .trades import price, profit_factor

    parts = [price(raw, spec | {"ticks": float(k)}).withColumn("ticks", F.lit(k)) for k in range(most + 1)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys, "ticks").agg(F.count("*").alias("trades"), F.sum("pnl_net").alias("pnl"), profit_factor(F.col("pnl_net")).alias("profit_factor"))


def parameters(axes: list[str]) -> Column:
    """A map from the name of each parameter to its value, as a double."""
    return F.create_map(*(x for a in axes for x in (F.lit(a), F.col(a).cast("double"))))


def exit_breakdown(trades: DataFrame, keys: list[str], kinds: list[str], kind: str = "exit_type") -> DataFrame:
    """exits: a map from each of kinds to count, pct of all trades and avg_pnl (0 for kinds without trades).

    keys may hold maps, which can't be grouped by: they must depend on the other keys, and are carried along.
    """
    maps = [k for k in keys if trades.schema[k].dataType.typeName() == "map"]
    plain = [k for k in keys if k not in maps]
    one = [F.count(F.when(F.col(kind) == k, 1)).alias(f"_n{i}") for i, k in enumerate(kinds)]
    one += [F.avg(F.when(F.col(kind) == k, F.col("pnl_net"))).alias(f"_p{i}") for i, k in enumerate(kinds)]
    got = trades.groupBy(*plain).agg(F.count("*").alias("_n"), *one, *(F.first(m).alias(m) for m in maps))
    cell = lambda i: F.struct(F.col(f"_n{i}").alias("count"), (100.0 * F.col(f"_n{i}") / F.col("_n")).alias("pct"), F.coalesce(f"_p{i}", F.lit(0.0)).alias("avg_pnl"))
    return got.select(*keys, F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), cell(i)))).alias("exits"))


def grade(value: Column, go: float, warn: float) -> Column:
    return F.when(value >= go, "GO").when(value >= warn, "WARN").otherwise("KILL")


def diverse_topk(spark: SparkSession, candidates: DataFrame, axes: list[str], score: str, k: int, limit: int = 40, weight: float = 0.6) -> DataFrame:
    """Greedy choice among the `limit` best: weight * scaled score + (1 - weight) * least distance to the chosen, over the number of axes.

    A top-k report over at most `limit` rows, so the loop runs on the driver.
    """
    rows = [r.asDict() for r in candidates.orderBy(F.desc(score), *axes).limit(limit).collect()]
    if not rows:
        return candidates.withColumn("rank", F.lit(0)).limit(0)
    top, low = max(r[score] for r in rows), min(r[score] for r in rows)
    scaled = lambda r: (r[score] - low) / (top - low) if top > low else 1.0
    far = lambda a, b: sum(a[x] != b[x] for x in axes) / len(axes)
    chosen = [rows.pop(0)]
    while rows and len(chosen) < k:
        best = max(range(len(rows)), key=lambda i: (weight * scaled(rows[i]) + (1 - weight) * min(far(rows[i], c) for c in chosen), -i))
        chosen.append(rows.pop(best))
    return spark.createDataFrame([(*(c[f] for f in candidates.columns), i + 1) for i, c in enumerate(chosen)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", rank int")
