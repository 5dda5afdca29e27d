"""Trades: detection, costs, stops, equity and summaries.

A trade is a run of non-zero signals: it opens on the run's first bar and closes on the first bar
behind it.  A run that touches the last bar is no trade, unless open positions are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, dollar_neutral
from .rolling import ordered
from .signals import with_runs

#: Multiplier, tick, of the two legs, commission a side and contract, slippage in ticks.
SPEC = {"mult_a": 20.0, "tick_a": 0.25, "mult_b": 5.0, "tick_b": 1.0, "commission": 2.5, "ticks": 1.0}


def detect(df: DataFrame, keys: list[str], order: str = "bar_idx", split_on_flip: bool = False, mark_open: bool = False, dollar_stop: float = 0.0, spec: dict = SPEC) -> DataFrame:
    """One row a trade: entry/exit bars, times, prices, side, sizes.

    split_on_flip: a change of sign closes and reopens.  mark_open: a run at the end closes on the last
    bar.  dollar_stop: the first bar, from the entry on, with a running loss beyond it is the exit.
    """
    runs = with_runs(df, keys, order, split_on_flip=split_on_flip)
    at = ordered(keys, order)
    nxt = runs.withColumn("_next", F.struct(*(F.lead(c).over(at).alias(c) for c in (order, "ts", "close_a", "close_b"))))
    inside = Window.partitionBy(*keys, "_run").orderBy(order)
    head = lambda c: F.first(c).over(inside)
    rows = nxt.filter(F.col("_run").isNotNull()).withColumns({"side": head("signal"), "e_bar": head(order), "e_ts": head("ts"), "e_a": head("close_a"), "e_b": head("close_b"), "e_beta": head("beta")})
    rows = rows.withColumn("_nb", dollar_neutral(F.col("e_a"), spec["mult_a"], F.col("e_b"), spec["mult_b"], F.col("e_beta"), F.lit(1)))
    open_pnl = pnl_gross(F.col("side"), F.lit(1), F.col("_nb"), entry_price(F.col("e_a"), F.col("side"), spec, "a"), entry_price(F.col("e_b"), F.col("side"), spec, "b"), F.col("close_a"), F.col("close_b"), spec)
    stopped = (open_pnl < -dollar_stop) if dollar_stop > 0 else F.lit(False)
    here = F.struct(F.col(order).alias(order), "ts", "close_a", "close_b")
    got = rows.groupBy(*keys, "_run").agg(
        *(F.first(c).alias(c) for c in ("side", "e_bar", "e_ts", "e_a", "e_b", "e_beta", "_nb")),
        F.min(F.when(stopped, here)).alias("_stop"),
        F.max_by("_next", order).alias("_behind"),
        F.max(here).alias("_last"),
    )
    exit_ = F.coalesce("_stop", F.when(F.col(f"_behind.{order}").isNotNull(), F.col("_behind")), F.col("_last") if mark_open else F.lit(None))
    out = got.withColumn("_exit", exit_).filter(F.col("_exit").isNotNull())
    return out.select(
        *keys, F.col("e_bar").alias("entry_bar"), F.col(f"_exit.{order}").alias("exit_bar"), F.col("e_ts").alias("entry_time"), F.col("_exit.ts").alias("exit_time"), "side",
        F.col("e_a").alias("raw_entry_a"), F.col("e_b").alias("raw_entry_b"), F.col("_exit.close_a").alias("raw_exit_a"), F.col("_exit.close_b").alias("raw_exit_b"), F.col("e_beta").alias("beta"), F.lit(1).alias("n_a"), F.col("_nb").alias("n_b"),
    )


def entry_price(price: Column, side: Column, spec: dict, leg: str) -> Column:
    sign = 1 if leg == "a" else -1
    return price + sign * side * spec["ticks"] * spec[f"tick_{leg}"]


def exit_price(price: Column, side: Column, spec: dict, leg: str) -> Column:
    sign = -1 if leg == "a" else 1
    return price + sign * side * spec["ticks"] * spec[f"tick_{leg}"]


def pnl_gross(side: Column, n_a: Column, n_b: Column, entry_a: Column, entry_b: Column, exit_a: Column, exit_b: Column, spec: dict) -> Column:
    return side * (n_a * (exit_a - entry_a) * spec["mult_a"] - n_b * (exit_b - entry_b) * spec["mult_b"])


def price(trades: DataFrame, spec: dict = SPEC) -> DataFrame:
    """Trades with slipped prices, gross PnL, costs and net PnL."""
    side = F.col("side")
    out = trades.withColumns({
        "entry_price_a": entry_price(F.col("raw_entry_a"), side, spec, "a"), "entry_price_b": entry_price(F.col("raw_entry_b"), side, spec, "b"),
        "exit_price_a": exit_price(F.col("raw_exit_a"), side, spec, "a"), "exit_price_b": exit_price(F.col("raw_exit_b"), side, spec, "b"),
    })
    out = out.withColumn("pnl_gross", pnl_gross(side, F.col("n_a"), F.col("n_b"), F.col("entry_price_a"), F.col("entry_price_b"), F.col("exit_price_a"), F.col("exit_price_b"), spec))
    out = out.withColumn("costs", F.lit(spec["commission"]) * (F.col("n_a") + F.col("n_b")) * 2)
    return out.withColumn("pnl_net", F.col("pnl_gross") - F.col("costs"))


def backtest(df: DataFrame, keys: list[str], order: str = "bar_idx", spec: dict = SPEC, **options) -> DataFrame:
    return price(detect(df, keys, order, spec=spec, **options), spec)


def profit_factor(pnl: Column) -> Column:
    gains, losses = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl <= 0, -pnl))
    inf = F.lit(float("inf"))
    return F.when(F.coalesce(losses, F.lit(0.0)) > 0, F.coalesce(gains, F.lit(0.0)) / losses).when(F.coalesce(gains, F.lit(0.0)) > 0, inf).otherwise(0.0)


def summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    pnl = F.col("pnl_net")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), (100.0 * F.avg((pnl > 0).cast("double"))).alias("win_rate"), F.sum(pnl).alias("pnl"),
        profit_factor(pnl).alias("profit_factor"), F.avg(pnl).alias("avg_pnl"), F.avg(F.col("exit_bar") - F.col("entry_bar")).alias("avg_bars"),
    )


def drawdown(trades: DataFrame, keys: list[str], order: str = "exit_bar") -> DataFrame:
    """Each trade with its cumulative PnL, the running peak (from the first value on) and the drawdown."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("cum", F.sum("pnl_net").over(w))
    out = out.withColumn("peak", F.max("cum").over(w))
    return out.withColumn("drawdown", F.col("cum") - F.col("peak"))


def equity(bars: DataFrame, trades: DataFrame, keys: list[str], capital: float = 100_000.0, order: str = "bar_idx", spec: dict = SPEC) -> DataFrame:
    """Equity of every bar: capital, what closed trades made, and the open trade at market.

    Trades don't overlap, so each bar belongs to at most one; it finds it by carrying the last entry forward.
    """
    fields = ["entry_bar", "exit_bar", "side", "n_a", "n_b", "entry_price_a", "entry_price_b", "pnl_net"]
    marked = bars.join(trades.select(*keys, F.col("entry_bar").alias(order), F.struct(*fields).alias("_t")), [*keys, order], "left")
    closed = trades.groupBy(*keys, F.col("exit_bar").alias(order)).agg(F.sum("pnl_net").alias("_done"))
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    held = marked.join(closed, [*keys, order], "left").withColumns({"_t": F.last("_t", ignorenulls=True).over(w), "_made": F.coalesce(F.sum("_done").over(w), F.lit(0.0))})
    open_ = F.when((F.col(order) >= F.col("_t.entry_bar")) & (F.col(order) < F.col("_t.exit_bar")), pnl_gross(F.col("_t.side"), F.col("_t.n_a"), F.col("_t.n_b"), F.col("_t.entry_price_a"), F.col("_t.entry_price_b"), F.col("close_a"), F.col("close_b"), spec))
    return held.select(*keys, order, "ts", (F.lit(capital) + F.col("_made") + F.coalesce(open_, F.lit(0.0))).alias("equity"))


def performance(curve: DataFrame, trades: DataFrame, keys: list[str], bars_per_day: int = 264, order: str = "bar_idx") -> DataFrame:
    """Sharpe of bar returns, Calmar of the compounded return, largest drawdown in percent and its longest stretch, with the trades' summary; zeros without trades."""
    at = ordered(keys, order)
    w = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumns({"_r": F.coalesce(div(F.col("equity") - F.lag("equity").over(at), F.lag("equity").over(at)), F.lit(0.0)), "_first": F.lag("equity").over(at).isNull(), "_peak": F.max("equity").over(w)})
    rows = rows.withColumns({"_dd": F.col("_peak") - F.col("equity"), "_ddp": 100 * div(F.col("_peak") - F.col("equity"), F.col("_peak"))})
    rows = rows.withColumn("_isle", F.sum((F.col("_dd") <= 0).cast("int")).over(w))
    longest = rows.filter("_dd > 0").groupBy(*keys, "_isle").count().groupBy(*keys).agg(F.max("count").alias("max_dd_bars"))
    year = bars_per_day * 252
    agg = rows.groupBy(*keys).agg(
        F.avg(F.when(~F.col("_first"), F.col("_r"))).alias("_m"), F.stddev_pop(F.when(~F.col("_first"), F.col("_r"))).alias("_s"), F.max("_ddp").alias("max_dd_pct"),
        F.min_by("equity", order).alias("_from"), F.max_by("equity", order).alias("_to"), F.count("*").alias("_n"),
    )
    agg = agg.join(longest, keys, "left").join(summary(trades, keys), keys, "left")
    sharpe = F.coalesce(div(F.col("_m"), F.when(F.col("_s") > 1e-12, F.col("_s"))) * F.sqrt(F.lit(float(year))), F.lit(0.0))
    grown = F.pow(F.coalesce(div(F.col("_to"), F.col("_from")), F.lit(1.0)), F.lit(float(year)) / F.col("_n")) - 1
    annual = F.when(F.isnan(grown) | (F.abs(grown) == float("inf")), 0.0).otherwise(100 * grown)
    calmar = F.when(F.col("max_dd_pct") > 0, annual / F.nullif(F.col("max_dd_pct"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    found = {"trades": F.col("trades"), **{c: F.col(c) for c in ("win_rate", "pnl", "profit_factor", "avg_pnl")}, "sharpe": sharpe, "max_dd_pct": F.col("max_dd_pct"), "max_dd_bars": F.coalesce("max_dd_bars", F.lit(0)).cast("bigint"), "calmar": calmar}
    return agg.select(*keys, *(F.when(F.col("trades").isNotNull(), v).otherwise(0).alias(k) for k, v in found.items()))


def loss_streaks(trades: DataFrame, keys: list[str], order: str = "exit_bar", zero_is_loss: bool = True) -> DataFrame:
    """Longest run of losing trades and the largest sum lost in one run."""
    lost = F.col("pnl_net") <= 0 if zero_is_loss else F.col("pnl_net") < 0
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    isles = trades.withColumn("_lost", lost).withColumn("_isle", F.sum((~lost).cast("int")).over(w)).filter("_lost")
    runs = isles.groupBy(*keys, "_isle").agg(F.count("*").alias("n"), F.sum("pnl_net").alias("lost"))
    return runs.groupBy(*keys).agg(F.max("n").alias("max_losses"), F.min("lost").alias("max_loss_run"))


def exit_type(z: Column, signal: Column, leave: float, stop: float, bars: Column | None = None, time_stop: int = 0, flat: Column | None = None) -> Column:
    """FLAT before TIME_STOP before Z_STOP before Z_EXIT."""
    out = F.when(F.coalesce(flat, F.lit(False)), "FLAT") if flat is not None else F.when(F.lit(False), "FLAT")
    if bars is not None and time_stop > 0:
        out = out.when(bars >= time_stop, "TIME_STOP")
    return out.when(F.abs(z) > stop, "Z_STOP").otherwise("Z_EXIT")


def auto_exit(side: Column, z: Column, pnl: Column, minute: Column, leave: float, dollar_stop: float, flat: int, session: tuple[int, int]) -> Column:
    """Why an open position is closed now: Z_EXIT before DOLLAR_STOP before TIME_STOP, else null.

    A long position leaves at z >= -leave, a short one at z <= leave; levels of 0 are off.  minute is the
    bar's minute of the day.  In a session over midnight the evening belongs to the next day, so only
    minutes before its start count as flat time.  Null z and pnl fire nothing, and neither does side 0.
    """
    late = minute >= flat
    if session[0] > session[1]:
        late = late & (minute < session[0])
    out = F.when(F.coalesce(side, F.lit(0)) == 0, F.lit(None).cast("string"))
    if leave > 0:
        out = out.when(side * z >= -leave, "Z_EXIT")
    if dollar_stop > 0:
        out = out.when(pnl <= -dollar_stop, "DOLLAR_STOP")
    return out.when(late, "TIME_STOP")
