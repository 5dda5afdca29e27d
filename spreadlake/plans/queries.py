"""Registered queries of the engine's operators and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import bars, rolling, signals, trades, validation
from . import inputs
from .inputs import ENTRY, KEYS, LEAVE, PF, STOP, cte, filter_sql, price_sql, query, runs_sql, trades_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


TOD = "hour(ts) * 3600 + minute(ts) * 60 + second(ts)::INT"


@register("session_filter", query(f"SELECT instrument, ts, close FROM ticks WHERE {TOD} >= 1080 * 60 OR {TOD} < 900 * 60", "ticks"))
def _(spark, d):
    return inputs.ticks(spark, d).filter(bars.in_session(F.col("ts"), 1050, 930, 30)).select("instrument", "ts", "close")


@register("trading_window", query(f"SELECT instrument, ts, close FROM ticks WHERE {TOD} >= 240 * 60 AND {TOD} < 840 * 60", "ticks"))
def _(spark, d):
    return inputs.ticks(spark, d).filter(bars.in_window(F.col("ts"), 240, 840)).select("instrument", "ts", "close")


HOURLY = "SELECT instrument, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2"
cte("hourly", HOURLY, "ticks")


@register("ohlcv_resample", query("SELECT * FROM hourly", "hourly"))
def _(spark, d):
    return bars.resample(inputs.ticks(spark, d), "1 hour", ["instrument"])


cte("kept", f"SELECT * FROM hourly WHERE volume > 0 AND ({TOD} >= 1050 * 60 OR {TOD} < 930 * 60)", "hourly")
cte("grid", "SELECT instrument, unnest(generate_series(lo, hi, INTERVAL '60 minutes')) AS ts FROM (SELECT instrument, min(ts) AS lo, max(ts) AS hi FROM kept GROUP BY 1)", "kept")
_FILL = ", ".join(f"last_value(k.{c} IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in bars.VALUES)


@register("minute_grid_ffill", query(f"SELECT * FROM (SELECT g.instrument, g.ts, {_FILL} FROM grid g LEFT JOIN kept k ON k.instrument = g.instrument AND k.ts = g.ts WHERE isodow(g.ts) < 6) WHERE close IS NOT NULL AND ({TOD} >= 1050 * 60 OR {TOD} < 930 * 60)", "grid"))
def _(spark, d):
    return bars.clean(bars.resample(inputs.ticks(spark, d), "1 hour", ["instrument"]), ["instrument"], 1050, 930, minutes=60)


@register("align_inner", query("SELECT * FROM aligned", "aligned"))
def _(spark, d):
    return inputs.aligned(spark, d)


@register("asof_align", query("SELECT a.event_id, a.ts, a.value AS click_value, b.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.ts >= b.ts"))
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.lit(1))
    left = e.filter("event_type = 'click'").select("k", "event_id", "ts", F.col("value").alias("click_value"))
    right = e.filter("event_type = 'view'").select("k", "ts", F.col("value").alias("view_value"))
    return bars.asof(left, right, ["k"], ["view_value"], block="day").drop("k")


@register("union_ffill", query("""SELECT * FROM (SELECT ts, last_value(a IGNORE NULLS) OVER w AS click_close, last_value(b IGNORE NULLS) OVER w AS view_close FROM
 (SELECT coalesce(x.ts, y.ts) AS ts, x.close AS a, y.close AS b FROM (SELECT * FROM hourly WHERE instrument = 'click') x FULL JOIN (SELECT * FROM hourly WHERE instrument = 'view') y ON x.ts = y.ts)
 WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)) WHERE click_close IS NOT NULL AND view_close IS NOT NULL""", "hourly"))
def _(spark, d):
    hours = bars.resample(inputs.ticks(spark, d), "1 hour", ["instrument"]).withColumn("pair", F.lit("click_view"))
    a = hours.filter("instrument = 'click'").select("pair", "ts", F.col("close").alias("click_close"))
    b = hours.filter("instrument = 'view'").select("pair", "ts", F.col("close").alias("view_close"))
    return bars.union_ffill(a, b, "pair", "click_close", "view_close").drop("pair")


@register("session_starts", query("SELECT instrument, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY instrument ORDER BY ts)) > 7200, false) AS session_start FROM hourly", "hourly"))
def _(spark, d):
    return bars.session_starts(bars.resample(inputs.ticks(spark, d), "1 hour", ["instrument"]), ["instrument"], 120).select("instrument", "ts", "session_start")


@register("rolling_ols", query(f"SELECT bar_idx, {s6('beta', 'alpha', 'spread')} FROM hedged", "hedged"))
def _(spark, d):
    return inputs.hedged(spark, d).select("bar_idx", *r6("beta", "alpha", "spread"))


@register("rolling_zscore", query(f"SELECT bar_idx, {s6('zscore')} FROM hedged", "hedged"))
def _(spark, d):
    return inputs.hedged(spark, d).select("bar_idx", *r6("zscore"))


_W = inputs.rows(300)
cte("long_ols", f"SELECT bar_idx, CASE WHEN count(*) OVER {_W} = 300 THEN covar_samp(la, lb) OVER {_W} / nullif(var_samp(lb) OVER {_W}, 0) END AS beta FROM ols", "ols")


@register("rolling_ols_long", query(f"SELECT bar_idx, {s6('beta')} FROM long_ols", "long_ols"))
def _(spark, d):
    return rolling.rolling_ols(inputs.aligned(spark, d), 300, 30, KEYS, "bar_idx", index="bar_idx").select("bar_idx", *r6("beta"))


def _one_metric(name: str, col: str, make) -> None:
    register(name, query(f"SELECT bar_idx, {s6(col)} FROM measured", "measured"))(
        lambda spark, d: make(inputs.hedged(spark, d)).select("bar_idx", *r6(col))
    )


_one_metric("rolling_corr", "correlation", lambda h: rolling.rolling_corr(h, inputs.CORR, KEYS, "bar_idx", index="bar_idx"))
_one_metric("rolling_adf", "adf_stat", lambda h: rolling.rolling_adf(h, inputs.ADF, KEYS, "bar_idx", index="bar_idx"))
_one_metric("rolling_hurst", "hurst", lambda h: rolling.rolling_hurst(h, inputs.HURST, KEYS, "bar_idx", index="bar_idx"))
_one_metric("rolling_halflife", "half_life", lambda h: rolling.rolling_halflife(h, inputs.HL, KEYS, "bar_idx", index="bar_idx"))


cte("masks", "SELECT *, coalesce(hurst < 0.45, false) AND coalesce(correlation > 0.20, false) AND coalesce(adf_stat < -2.0, false) AND coalesce(half_life BETWEEN 0.5 AND 120, false) AS regime, coalesce(adf_stat < -2.0 AND hurst < 0.5 AND correlation > 0.20, false) AS gate FROM measured", "measured")


@register("regime_mask", query("SELECT bar_idx, regime FROM masks", "masks"))
def _(spark, d):
    m = inputs.measured(spark, d)
    return m.select("bar_idx", signals.regime_mask(m.columns, 0.45, 0.20, -2.0, (0.5, 120)).alias("regime"))


@register("gate_mask", query("SELECT bar_idx, gate FROM masks", "masks"))
def _(spark, d):
    return inputs.measured(spark, d).select("bar_idx", signals.gate_mask(-2.0, 0.5, 0.20).alias("gate"))


def _lin(v: str, worst: float, best: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, ({v} - {worst}) / ({best} - {worst}))) END"


_C = signals.CONFIDENCE
_T = "CASE WHEN half_life IS NULL OR half_life < 3 OR half_life > 200 THEN 0.0 WHEN half_life BETWEEN 10 AND 60 THEN 1.0 WHEN half_life < 10 THEN (half_life - 3) / 7.0 ELSE (200 - half_life) / 140.0 END"
cte("confident", f"SELECT *, CASE WHEN coalesce(adf_stat < -1.0, false) THEN 100.0 * (0.4 * {_lin('adf_stat', *_C['adf'])} + 0.25 * {_lin('hurst', *_C['hurst'])} + 0.2 * {_lin('correlation', *_C['corr'])} + 0.15 * {_T}) ELSE 0.0 END AS confidence FROM measured", "measured")


@register("confidence_score", query(f"SELECT bar_idx, {s6('confidence')} FROM confident", "confident"))
def _(spark, d):
    return inputs.measured(spark, d).select("bar_idx", F.round(signals.confidence(), 6).alias("confidence"))


@register("signals_fsm", query("SELECT bar_idx, signal FROM signalled", "signalled"))
def _(spark, d):
    return inputs.signalled(spark, d).select("bar_idx", "signal")


cte("sig_m", "SELECT m.*, s.signal FROM measured m JOIN signalled s USING (bar_idx)", "measured", "signalled")
cte("conf_m", "SELECT c.*, s.signal FROM confident c JOIN signalled s USING (bar_idx)", "confident", "signalled")


def _sig_m(spark, d):
    return signals.state_machine(inputs.measured(spark, d), ENTRY, LEAVE, STOP, KEYS, "bar_idx")


cte("gated", filter_sql("sig_m", "correlation > 0.20"), "sig_m")


@register("gate_filter", query("SELECT bar_idx, signal FROM gated", "gated"))
def _(spark, d):
    return signals.entry_filter(_sig_m(spark, d), signals.metric_gate("correlation", "gt", 0.20), KEYS, "bar_idx").select("bar_idx", "signal")


cte("doubled", filter_sql("sig_m", "correlation > 0.0 AND hurst < 0.5"), "sig_m")


@register("double_gate_filter", query("SELECT bar_idx, signal FROM doubled", "doubled"))
def _(spark, d):
    ok = signals.metric_gate("correlation", "gt", 0.0) & signals.metric_gate("hurst", "lt", 0.5)
    return signals.entry_filter(_sig_m(spark, d), ok, KEYS, "bar_idx").select("bar_idx", "signal")


cte("conf_f", filter_sql("conf_m", "confidence >= 40"), "conf_m")


@register("confidence_filter", query("SELECT bar_idx, signal FROM conf_f", "conf_f"))
def _(spark, d):
    return signals.entry_filter(_sig_m(spark, d), signals.confidence() >= 40, KEYS, "bar_idx").select("bar_idx", "signal")


cte("stopped", f"SELECT *  EXCLUDE (signal), (CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY bar_idx) <= 2 THEN signal ELSE 0 END)::TINYINT AS signal FROM ({runs_sql('signalled')})", "signalled")


@register("time_stop", query("SELECT bar_idx, signal FROM stopped", "stopped"))
def _(spark, d):
    return signals.time_stop(inputs.signalled(spark, d), 2, KEYS, "bar_idx").select("bar_idx", "signal")


# Daily bars have no time of day; these two take a made-up one from the bar's number.
cte("timed", "SELECT * EXCLUDE (ts), ts + INTERVAL '1 minute' * ((bar_idx * 97) % 1440) AS ts FROM signalled", "signalled")
cte("forced", "SELECT * EXCLUDE (signal), (CASE WHEN hour(ts) * 60 + minute(ts) >= 930 OR hour(ts) * 60 + minute(ts) < 120 THEN 0 ELSE signal END)::TINYINT AS signal FROM timed", "timed")
cte("windowed", filter_sql("forced", "hour(ts) * 60 + minute(ts) >= 120 AND hour(ts) * 60 + minute(ts) < 840"), "forced")


def _timed(spark, d):
    return inputs.signalled(spark, d).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=(F.col("bar_idx") * 97 % 1440).cast("int")))


@register("window_filter", query("SELECT bar_idx, signal FROM windowed", "windowed"))
def _(spark, d):
    return signals.window_filter(_timed(spark, d), 120, 840, 930, KEYS, "bar_idx").select("bar_idx", "signal")


@register("legacy_window", query("SELECT bar_idx, (CASE WHEN hour(ts) * 60 + minute(ts) >= 240 AND hour(ts) * 60 + minute(ts) < 840 THEN signal ELSE 0 END)::TINYINT AS signal FROM timed", "timed"))
def _(spark, d):
    return signals.trading_window(_timed(spark, d), 240, 840).select("bar_idx", "signal")


TRADE = "entry_bar, exit_bar, entry_time, exit_time, side, n_a, n_b"
MONEY = ("entry_price_a", "entry_price_b", "exit_price_a", "exit_price_b", "pnl_gross", "costs", "pnl_net")


@register("trades", query(f"SELECT {TRADE}, {s6(*MONEY)} FROM trades", "trades"))
def _(spark, d):
    return inputs.traded(spark, d).select(*TRADE.split(", "), *r6(*MONEY))


@register("position_size", query(f"SELECT bar_idx, coalesce(greatest(round_even(close_a * 20 / (close_b * 5) * abs(coalesce(beta, 1)), 0), 1), 1)::INT AS n_b FROM hedged", "hedged"))
def _(spark, d):
    return inputs.hedged(spark, d).select("bar_idx", exprs.dollar_neutral(F.col("close_a"), 20.0, F.col("close_b"), 5.0, F.col("beta"), F.lit(1)).alias("n_b"))


_OPTS = ", ".join(f"(SELECT {{'error': abs(round_even(q * {m}, 0) - q * {m}), 'm': {m}, 'n_b': round_even(q * {m}, 0)::INT}})" for m in range(1, 6))
cte("lots", f"SELECT bar_idx, CASE WHEN q IS NULL OR q <= 0 OR len(list_filter([{_OPTS}], lambda o: o.n_b >= 1)) = 0 THEN {{'error': 0.0, 'm': 1, 'n_b': 1}} ELSE list_sort(list_filter([{_OPTS}], lambda o: o.n_b >= 1))[1] END AS best FROM (SELECT bar_idx, close_a * 20 / (close_b * 5) * beta AS q FROM hedged)", "hedged")


@register("lot_multiplier", query("SELECT bar_idx, best.m AS m, best.n_b AS n_b, round(best.error, 6) AS error FROM lots", "lots"))
def _(spark, d):
    q = F.col("close_a") * 20 / (F.col("close_b") * 5) * F.col("beta")
    best = inputs.hedged(spark, d).select("bar_idx", exprs.best_multiplier(q, 5).alias("best"))
    return best.select("bar_idx", "best.m", "best.n_b", F.round("best.error", 6).alias("error"))


_S = trades.SPEC
cte("in_trade", f"SELECT r.*, lead(r.ts) OVER (ORDER BY r.bar_idx) AS nts, first_value(signal) OVER v AS side, first_value(close_a) OVER v AS ea, first_value(close_b) OVER v AS eb, first_value(beta) OVER v AS ebeta FROM ({runs_sql('signalled')}) r WINDOW v AS (PARTITION BY run ORDER BY bar_idx)", "signalled")
cte("open_pnl", f"SELECT *, side * ((close_a - (ea + side * {_S['tick_a']})) * {_S['mult_a']} - coalesce(greatest(round_even(ea * 20 / (eb * 5) * abs(coalesce(ebeta, 1)), 0), 1), 1) * (close_b - (eb - side * {_S['tick_b']})) * {_S['mult_b']}) AS live FROM in_trade WHERE run IS NOT NULL", "in_trade")


@register("dollar_stop", query("SELECT min(bar_idx) AS entry_bar, coalesce(min(CASE WHEN live < -2000 THEN bar_idx END), max(bar_idx) + 1) AS exit_bar FROM open_pnl GROUP BY run HAVING min(CASE WHEN live < -2000 THEN bar_idx END) IS NOT NULL OR arg_max(nts IS NOT NULL, bar_idx)", "open_pnl"))
def _(spark, d):
    return inputs.traded(spark, d, dollar_stop=2000.0).select("entry_bar", "exit_bar")


@register("equity_curve", query(f"SELECT bar_idx, {s6('equity')} FROM equity", "equity"))
def _(spark, d):
    s = inputs.signalled(spark, d)
    return trades.equity(s, trades.backtest(s, KEYS), KEYS).select("bar_idx", *r6("equity"))


SUMMARY = f"count(*) AS trades, 100.0 * avg((pnl_net > 0)::INT) AS win_rate, sum(pnl_net) AS pnl, {PF} AS profit_factor, avg(pnl_net) AS avg_pnl, avg(exit_bar - entry_bar) AS avg_bars"


@register("backtest_summary", query(f"SELECT trades, {s6('win_rate', 'pnl', 'profit_factor', 'avg_pnl', 'avg_bars')} FROM (SELECT {SUMMARY} FROM trades)", "trades"))
def _(spark, d):
    return trades.summary(inputs.traded(spark, d), KEYS).select("trades", *r6("win_rate", "pnl", "profit_factor", "avg_pnl", "avg_bars"))


cte("curve", "SELECT *, equity / lag(equity) OVER (ORDER BY bar_idx) - 1 AS r, max(equity) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS peak FROM equity", "equity")
cte("dips", "SELECT *, sum((equity >= peak)::INT) OVER (ORDER BY bar_idx) AS isle FROM curve", "curve")
_PERF = f"""SELECT trades, {s6('win_rate', 'pnl', 'profit_factor', 'avg_pnl', 'sharpe', 'max_dd_pct')}, max_dd_bars, {s6('calmar')} FROM (SELECT {SUMMARY} FROM trades),
 (SELECT avg(r) / stddev_pop(r) * sqrt(264 * 252) AS sharpe, max(100 * (peak - equity) / peak) AS max_dd_pct, 100 * (pow(1 + (arg_max(equity, bar_idx) - arg_min(equity, bar_idx)) / arg_min(equity, bar_idx), 264 * 252 / count(*)) - 1) / max(100 * (peak - equity) / peak) AS calmar FROM curve),
 (SELECT coalesce(max(n), 0)::BIGINT AS max_dd_bars FROM (SELECT count(*) AS n FROM dips WHERE equity < peak GROUP BY isle))"""


@register("performance", query(_PERF, "trades", "dips"))
def _(spark, d):
    s = inputs.signalled(spark, d)
    t = trades.backtest(s, KEYS)
    return trades.performance(trades.equity(s, t, KEYS), t, KEYS).select("trades", *r6("win_rate", "pnl", "profit_factor", "avg_pnl", "sharpe", "max_dd_pct"), "max_dd_bars", *r6("calmar"))


cte("cums", "SELECT *, sum(pnl_net) OVER (ORDER BY exit_bar ROWS UNBOUNDED PRECEDING) AS cum FROM trades", "trades")


@register("drawdown_streaks", query("SELECT exit_bar, round(cum, 6) AS cum, round(cum - max(cum) OVER (ORDER BY exit_bar ROWS UNBOUNDED PRECEDING), 6) AS drawdown FROM cums", "cums"))
def _(spark, d):
    return trades.drawdown(inputs.traded(spark, d), KEYS).select("exit_bar", *r6("cum", "drawdown"))


@register("consecutive_losses", query("SELECT max(n) AS max_losses, round(min(lost), 6) AS max_loss_run FROM (SELECT count(*) AS n, sum(pnl_net) AS lost FROM (SELECT *, sum((pnl_net > 0)::INT) OVER (ORDER BY exit_bar) AS isle FROM trades) WHERE pnl_net <= 0 GROUP BY isle)", "trades"))
def _(spark, d):
    return trades.loss_streaks(inputs.traded(spark, d), KEYS).select("max_losses", *r6("max_loss_run"))
