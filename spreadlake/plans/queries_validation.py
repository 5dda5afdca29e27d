"""Registered queries over trades, grids and whole series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import bars, kalman, signals, stats, ticks as tick_ops, trades, validation
from . import grid, inputs
from .inputs import KEYS, LEAVE, PF, STOP, cte, price_sql, query, runs_sql
from .queries import r6, register, s6

N_BARS = "(SELECT count(*) FROM aligned)"


def n_bars(spark: SparkSession, d: str) -> int:
    return inputs.aligned(spark, d).count()


# --- cross-validation -------------------------------------------------------------------------
cte("folds", f"SELECT f, f * (n // 10) + 10 AS lo, CASE WHEN f = 9 THEN n ELSE (f + 1) * (n // 10) END - 10 AS hi FROM (SELECT unnest(range(10)) AS f, {N_BARS} AS n)", "aligned")
cte("cv_paths", "SELECT row_number() OVER (ORDER BY a.f, b.f) - 1 AS path, a.f AS f1, b.f AS f2 FROM folds a JOIN folds b ON a.f < b.f", "folds")
cte("cv_trades", "SELECT p.path, t.pnl_net FROM trades t, cv_paths p WHERE EXISTS (SELECT 1 FROM folds f WHERE f.f IN (p.f1, p.f2) AND t.entry_bar >= f.lo AND t.entry_bar < f.hi) AND EXISTS (SELECT 1 FROM folds f WHERE f.f IN (p.f1, p.f2) AND t.exit_bar >= f.lo AND t.exit_bar < f.hi)", "trades", "cv_paths")
cte("cv", "SELECT path::INT AS path, count(*) AS n, CASE WHEN count(*) < 2 OR stddev_pop(pnl_net) < 1e-12 THEN 0 ELSE avg(pnl_net) / stddev_pop(pnl_net) END AS sharpe FROM cv_trades GROUP BY path HAVING count(*) >= 5", "cv_trades")


def _cv(spark, d):
    return validation.cpcv_paths(inputs.traded(spark, d), n_bars(spark, d), KEYS, purge=10)


@register("cpcv_paths", query(f"SELECT path, n, {s6('sharpe')} FROM cv", "cv"))
def _(spark, d):
    return _cv(spark, d).select("path", "n", *r6("sharpe"))


_CV = ("median_sharpe", "mean_sharpe", "std_sharpe", "min_sharpe", "pct_positive")


@register("cpcv_summary", query(f"SELECT {s6(*_CV)}, valid_paths FROM (SELECT median(sharpe) AS median_sharpe, avg(sharpe) AS mean_sharpe, stddev_pop(sharpe) AS std_sharpe, min(sharpe) AS min_sharpe, 100 * avg((sharpe > 0)::INT) AS pct_positive, count(*) AS valid_paths FROM cv)", "cv"))
def _(spark, d):
    return validation.cpcv_summary(_cv(spark, d), KEYS).select(*r6(*_CV), "valid_paths")


_MEAN, _STD, _TRIALS = 0.05, 0.1, 24
_root = math.sqrt(2 * math.log(_TRIALS))
_SR0 = f"({_MEAN} + {_STD} * (sqrt(2 * ln({_TRIALS})) - (ln(pi()) + ln(ln({_TRIALS}))) / (2 * sqrt(2 * ln({_TRIALS})))))"


cte("moments", "SELECT count(*) AS n, avg(pnl_net) AS m, stddev_pop(pnl_net) AS s FROM trades", "trades")
cte("shape", f"SELECT any_value(n) AS n, any_value(m / s) AS sharpe, avg(((pnl_net - m) / s) ** 3) AS skew, avg(((pnl_net - m) / s) ** 4) AS kurt, {_SR0} AS benchmark FROM trades, moments", "trades", "moments")
_DSR = exprs.normal_cdf_sql("((sharpe - benchmark) / sqrt((1 - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / (n - 1)))")


@register("deflated_sharpe", query(f"SELECT n, {s6('sharpe', 'skew', 'kurt', 'benchmark')}, round({_DSR}, 6) AS dsr FROM shape", "shape"))
def _(spark, d):
    return validation.deflated(inputs.traded(spark, d), KEYS, _TRIALS, _MEAN, _STD).select("n", *r6("sharpe", "skew", "kurt", "benchmark", "dsr"))


# --- walk-forward, limits, resampling ---------------------------------------------------------
cte("wf_folds", f"SELECT f, f * 125 + 500 AS lo, f * 125 + 625 AS hi FROM (SELECT unnest(range((({N_BARS} - 625) // 125) + 1)) AS f)", "aligned")
_WON, _LOST = "coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0)", "coalesce(-sum(pnl_net) FILTER (pnl_net < 0), 0)"
cte("wf", f"SELECT *, profit_factor > 1 AND n >= 3 AS go FROM (SELECT f::INT AS fold, count(pnl_net) AS n, coalesce(sum(pnl_net), 0) AS pnl, CASE WHEN {_LOST} > 0 THEN {_WON} / {_LOST} ELSE 0 END AS profit_factor FROM wf_folds LEFT JOIN trades ON entry_bar >= lo AND exit_bar <= hi GROUP BY f)", "trades", "wf_folds")


def _wf(spark, d):
    return validation.walk_forward(inputs.traded(spark, d), n_bars(spark, d), KEYS, 500, 125, 125)


@register("walk_forward", query(f"SELECT fold, n, {s6('pnl', 'profit_factor')}, go FROM wf", "wf"))
def _(spark, d):
    return _wf(spark, d).select("fold", "n", *r6("pnl", "profit_factor"), "go")


@register("recency", query("SELECT round(100 * avg(go::INT), 6) AS pct_go, count(*) AS folds FROM (SELECT * FROM wf ORDER BY fold DESC LIMIT 6)", "wf"))
def _(spark, d):
    return validation.recency(_wf(spark, d), KEYS).select(*r6("pct_go"), "folds")


cte("days", "SELECT exit_time::DATE AS day, sum(pnl_net) AS pnl, count(*) AS trades FROM trades GROUP BY 1", "trades")


@register("daily_pnl", query(f"SELECT day::VARCHAR AS day, {s6('pnl')}, trades FROM days", "days"))
def _(spark, d):
    return validation.daily_pnl(inputs.traded(spark, d), KEYS).select(F.col("day").cast("string").alias("day"), *r6("pnl"), "trades")


@register("propfirm", query("""SELECT worst_day, days_over_loss, worst_drawdown, bars_over_drawdown, days_over_loss = 0 AND bars_over_drawdown = 0 AS compliant FROM
 (SELECT round(min(pnl), 6) AS worst_day, count_if(pnl < -4500)::BIGINT AS days_over_loss FROM days), (SELECT round(min(dd), 6) AS worst_drawdown, count_if(dd < -5000)::BIGINT AS bars_over_drawdown FROM (SELECT equity - max(equity) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS dd FROM equity))""", "days", "equity"))
def _(spark, d):
    s = inputs.signalled(spark, d)
    t = trades.backtest(s, KEYS)
    return validation.account_limits(t, trades.equity(s, t, KEYS), KEYS).select(*r6("worst_day"), "days_over_loss", *r6("worst_drawdown"), "bars_over_drawdown", "compliant")


_SLIP = " UNION ALL ".join(f"SELECT {k}::INT AS ticks, * FROM ({price_sql('raw_trades', f'{k}.0')})" for k in range(4))


@register("slippage_sweep", query(f"SELECT ticks, count(*) AS trades, round(sum(pnl_net), 6) AS pnl, round({PF}, 6) AS profit_factor FROM ({_SLIP}) GROUP BY ticks", "raw_trades"))
def _(spark, d):
    raw = trades.detect(inputs.signalled(spark, d), KEYS)
    return validation.slippage_sweep(raw, KEYS, trades.SPEC).select("ticks", "trades", *r6("pnl", "profit_factor"))


def stream_sql(sim: str, at: str, seed: int, source: str) -> str:
    """source with h: the random stream of validation.stream in SQL."""
    v, steps = validation, []
    for name, begin in (("y", f"({sim} + {seed * v.SEED_STEP}) & {v.WORD}"), ("x", f"(y3 + {at} * {v.STEP}) & {v.WORD}")):
        steps.append(f"{begin} AS {name}0")
        steps += [f"(xor({name}{k}, {name}{k} >> 16) * {v.MIX}) & {v.WORD} AS {name}{k + 1}" for k in (0, 1)]
        steps.append(f"xor({name}2, {name}2 >> 16) AS {name}3")
    return f"SELECT * EXCLUDE (y0, y1, y2, y3, x0, x1, x2, x3), x3 AS h FROM (SELECT *, {', '.join(steps)} FROM {source})"


cte("mc", "SELECT sim, pnl_net, row_number() OVER (PARTITION BY sim ORDER BY h, entry_bar) AS place FROM (" + stream_sql("sim", "entry_bar", 42, "(SELECT sim, entry_bar, pnl_net FROM trades, (SELECT unnest(range(10000)) AS sim))") + ")", "trades")
cte("mc_cum", "SELECT *, sum(pnl_net) OVER (PARTITION BY sim ORDER BY place ROWS UNBOUNDED PRECEDING) AS cum FROM mc", "mc")


@register("monte_carlo_dd", query("SELECT sim, round(min(dd), 6) AS max_dd FROM (SELECT sim, cum - max(cum) OVER (PARTITION BY sim ORDER BY place ROWS UNBOUNDED PRECEDING) AS dd FROM mc_cum) GROUP BY sim", "mc_cum"))
def _(spark, d):
    return validation.monte_carlo_drawdown(inputs.traded(spark, d), 10_000, KEYS).select("sim", *r6("max_dd"))


_NUM = "SELECT pnl_net, row_number() OVER (ORDER BY entry_bar) - 1 AS i, count(*) OVER () AS n FROM trades"
cte("bs", "SELECT sim, draw, sum(pnl_net) OVER (PARTITION BY sim ORDER BY draw ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT sim, draw, h % (SELECT count(*) FROM trades) AS i FROM (" + stream_sql("sim", "draw", 42, "(SELECT s.sim, d.draw FROM (SELECT unnest(range(10000)) AS sim) s, (SELECT unnest(range(100)) AS draw) d)") + f")) p JOIN ({_NUM}) USING (i)", "trades")


@register("bootstrap", query("SELECT sim, coalesce(arg_min(hit, draw) FILTER (hit IS NOT NULL), 'open') AS outcome, coalesce(min(draw + 1) FILTER (hit IS NOT NULL), 100)::BIGINT AS trades FROM (SELECT *, CASE WHEN cum >= 20000 THEN 'target' WHEN cum <= -20000 THEN 'ruin' END AS hit FROM bs) GROUP BY sim", "bs"))
def _(spark, d):
    return validation.bootstrap(inputs.traded(spark, d), 10_000, 100, 20_000.0, 20_000.0, KEYS).drop("pair")


cte("perm_sims", "SELECT unnest(range(-1, 20)) AS sim")
cte("perm_bars", stream_sql("sim", "bar_idx", 7, "(SELECT sim, bar_idx, correlation FROM sig_m, perm_sims WHERE sim >= 0)"), "sig_m", "perm_sims")
cte("shuffle_z", "SELECT sim, b.bar_idx, s.correlation FROM (SELECT sim, bar_idx, row_number() OVER (PARTITION BY sim ORDER BY bar_idx) AS i FROM perm_bars) b JOIN (SELECT sim, correlation, row_number() OVER (PARTITION BY sim ORDER BY h, bar_idx) AS i FROM perm_bars) s USING (sim, i) UNION ALL SELECT -1, bar_idx, correlation FROM sig_m", "sig_m", "perm_bars")


def gated_sql(gate: str, key: str) -> str:
    """CTE body of raw trades (with key) of the signal's runs, each from the first bar on at which the gate (key, bar_idx, ok) is open."""
    return f"""SELECT {key}, run, min(bar_idx) AS entry_bar, max(bar_idx) + 1 AS exit_bar, arg_min(signal, bar_idx) AS side, arg_min(close_a, bar_idx) AS raw_entry_a, arg_min(close_b, bar_idx) AS raw_entry_b,
 arg_max(na, bar_idx) AS raw_exit_a, arg_max(nb, bar_idx) AS raw_exit_b, arg_min(beta, bar_idx) AS beta FROM (SELECT r.*, g.{key}, max((coalesce(ok, false))::INT) OVER (PARTITION BY g.{key}, run ORDER BY r.bar_idx ROWS UNBOUNDED PRECEDING) AS open_
 FROM (SELECT *, lead(close_a) OVER (ORDER BY bar_idx) AS na, lead(close_b) OVER (ORDER BY bar_idx) AS nb FROM ({runs_sql('signalled')})) r JOIN ({gate}) g USING (bar_idx) WHERE run IS NOT NULL) WHERE open_ = 1 GROUP BY {key}, run HAVING arg_max(na IS NOT NULL, bar_idx)"""


cte("perm_trades", price_sql(f"({gated_sql('SELECT sim, bar_idx, correlation > 0 AS ok FROM shuffle_z', 'sim')})"), "shuffle_z", "signalled")


def _permuted(spark: SparkSession, d: str, n_sims: int) -> DataFrame:
    rows = signals.state_machine(inputs.measured(spark, d), inputs.ENTRY, inputs.LEAVE, inputs.STOP, KEYS, "bar_idx")
    slim = rows.select("pair", "bar_idx", "ts", "close_a", "close_b", "beta", "signal", "correlation")
    return validation.permutation(slim, "correlation", F.col("correlation") > 0, n_sims, KEYS)


@register("permutation_test", query(f"SELECT CASE WHEN s.sim >= 0 THEN s.sim END AS sim, count(pnl_net) AS trades, coalesce(round(sum(pnl_net), 6), 0) AS pnl, round(coalesce({PF}, 0), 6) AS profit_factor FROM perm_sims s LEFT JOIN perm_trades t ON t.sim = s.sim GROUP BY s.sim", "perm_sims", "perm_trades"))
def _(spark, d):
    """Back-tests under a gate on the correlation (sim NULL) and on 20 orders of it."""
    return _permuted(spark, d, 20).select("sim", "trades", *r6("pnl", "profit_factor"))


@register("permutation_p_value")
def _(spark, d):
    """The same with 1,000 orders, and the share of them that does as well."""
    return validation.permutation_p(_permuted(spark, d, 1000), KEYS).select("sims", *r6("profit_factor", "p_value"))


# --- break-downs ------------------------------------------------------------------------------
@register("calendar_breakdown", query(f"SELECT year(entry_time)::INT AS year, quarter(entry_time)::INT AS quarter, month(entry_time)::INT AS month, count(*) AS trades, round(sum(pnl_net), 6) AS pnl, round(avg(pnl_net), 6) AS avg_pnl, round(100 * avg((pnl_net > 0)::INT), 6) AS win_rate FROM trades GROUP BY 1, 2, 3", "trades"))
def _(spark, d):
    t = inputs.traded(spark, d).withColumns({"year": F.year("entry_time"), "quarter": F.quarter("entry_time"), "month": F.month("entry_time")})
    return t.groupBy("year", "quarter", "month").agg(F.count("*").alias("trades"), F.round(F.sum("pnl_net"), 6).alias("pnl"), F.round(F.avg("pnl_net"), 6).alias("avg_pnl"), F.round(100 * F.avg((F.col("pnl_net") > 0).cast("double")), 6).alias("win_rate"))


@register("iso_week_breakdown", query("SELECT isoyear(entry_time)::INT AS iso_year, weekofyear(entry_time)::INT AS iso_week, hour(entry_time)::INT AS entry_hour, count(*) AS trades, round(sum(pnl_net), 6) AS pnl FROM trades GROUP BY 1, 2, 3", "trades"))
def _(spark, d):
    t = inputs.traded(spark, d)
    week = [F.expr("extract(YEAROFWEEK FROM entry_time)").cast("int").alias("iso_year"), F.weekofyear("entry_time").alias("iso_week"), F.hour("entry_time").alias("entry_hour")]
    return t.groupBy(*week).agg(F.count("*").alias("trades"), F.round(F.sum("pnl_net"), 6).alias("pnl"))


@register("side_weekday_heatmap", query("SELECT side, " + ", ".join(f"round(sum(pnl_net) FILTER (isodow(entry_time) = {i + 1}), 6) AS d{i}" for i in range(7)) + " FROM trades GROUP BY side", "trades"))
def _(spark, d):
    t = inputs.traded(spark, d).withColumn("day", F.concat(F.lit("d"), F.weekday("entry_time")))
    return t.groupBy("side").pivot("day", [f"d{i}" for i in range(7)]).agg(F.round(F.sum("pnl_net"), 6))


_DUR = "CASE WHEN exit_bar - entry_bar <= 1 THEN 'short' WHEN exit_bar - entry_bar <= 3 THEN 'middle' ELSE 'long' END"


@register("duration_buckets", query(f"SELECT {_DUR} AS bucket, count(*) AS trades, round(median(pnl_net), 6) AS median_pnl FROM trades GROUP BY 1", "trades"))
def _(spark, d):
    n = F.col("exit_bar") - F.col("entry_bar")
    return inputs.traded(spark, d).groupBy(F.when(n <= 1, "short").when(n <= 3, "middle").otherwise("long").alias("bucket")).agg(F.count("*").alias("trades"), F.round(F.median("pnl_net"), 6).alias("median_pnl"))


@register("histogram", query("SELECT bin::BIGINT AS bin, count(*) AS trades FROM (SELECT least(30, floor((pnl_net - lo) / ((hi - lo) / 30)) + 1) AS bin FROM trades, (SELECT min(pnl_net) AS lo, max(pnl_net) AS hi FROM trades)) GROUP BY bin", "trades"))
def _(spark, d):
    t = inputs.traded(spark, d).select("pnl_net")
    b = t.agg(F.min("pnl_net").alias("lo"), F.max("pnl_net").alias("hi"))
    bin_ = F.least(F.lit(30), F.floor((F.col("pnl_net") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30)) + 1)
    return t.crossJoin(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("trades"))


cte("exits", f"SELECT CASE WHEN exit_bar - entry_bar >= 5 THEN 'TIME_STOP' WHEN abs(zscore) > {STOP} THEN 'Z_STOP' ELSE 'Z_EXIT' END AS exit_type, pnl_net FROM trades JOIN hedged ON bar_idx = exit_bar", "trades", "hedged")


@register("exit_types", query("SELECT exit_type, count(*) AS trades, round(100 * count(*) / (SELECT count(*) FROM exits), 6) AS pct, round(avg(pnl_net), 6) AS avg_pnl FROM exits GROUP BY exit_type", "exits"))
def _(spark, d):
    s = inputs.signalled(spark, d)
    t = trades.backtest(s, KEYS).join(s.select("pair", F.col("bar_idx").alias("exit_bar"), "zscore"), ["pair", "exit_bar"])
    kind = trades.exit_type(F.col("zscore"), F.lit(0), LEAVE, STOP, F.col("exit_bar") - F.col("entry_bar"), 5)
    out = t.groupBy("pair", kind.alias("exit_type")).agg(F.count("*").alias("trades"), F.avg("pnl_net").alias("avg_pnl"))
    share = 100 * F.col("trades") / F.sum("trades").over(Window.partitionBy("pair"))
    return out.select("exit_type", "trades", F.round(share, 6).alias("pct"), *r6("avg_pnl"))


# --- grids ------------------------------------------------------------------------------------
AXES = {"entry": [1.0, 1.5, 1.7], "leave": [0.25, 0.5, 0.75], "stop": [1.8, 3.0], "time_stop": [0, 3]}


def _values(name: str) -> str:
    kind = "INT" if name == "time_stop" else "DOUBLE"
    return f"(SELECT unnest(range({len(AXES[name])}))::INT AS i_{name}, unnest([{', '.join(map(str, AXES[name]))}])::{kind} AS {name})"


_ID = "((i_entry * 3 + i_leave) * 2 + i_stop) * 2 + i_time_stop"
cte("configs", f"SELECT *, ({_ID})::BIGINT AS config_id FROM {', '.join(_values(a) for a in AXES)}")
cte(
    "g_states",
    """SELECT c.config_id, c.entry, c.leave, c.stop, bar_idx, 0 AS s FROM hedged, configs c WHERE bar_idx = 0 UNION ALL
SELECT p.config_id, p.entry, p.leave, p.stop, h.bar_idx, CASE WHEN h.zscore IS NULL THEN 0
 WHEN p.s = 0 THEN CASE WHEN h.zscore < -p.entry THEN 1 WHEN h.zscore > p.entry THEN 2 ELSE 0 END
 WHEN p.s = 1 THEN CASE WHEN h.zscore > -p.leave THEN 0 WHEN h.zscore < -p.stop THEN 3 ELSE 1 END
 WHEN p.s = 2 THEN CASE WHEN h.zscore < p.leave THEN 0 WHEN h.zscore > p.stop THEN 3 ELSE 2 END
 ELSE CASE WHEN abs(h.zscore) < p.leave THEN 0 ELSE 3 END END FROM g_states p JOIN hedged h ON h.bar_idx = p.bar_idx + 1""",
    "hedged", "configs",
)
_gw = "(PARTITION BY config_id ORDER BY bar_idx)"
cte("g_sig", "SELECT g.config_id, h.*, (CASE s WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END) AS signal FROM g_states g JOIN hedged h USING (bar_idx)", "g_states")


def _g_runs(source: str) -> str:
    return f"SELECT *, CASE WHEN signal <> 0 THEN sum(start_) OVER {_gw} END AS run FROM (SELECT *, (signal <> 0 AND coalesce(lag(signal) OVER {_gw}, 0) = 0)::INT AS start_ FROM {source})"


cte("g_stop", f"SELECT r.* EXCLUDE (signal, run, start_), CASE WHEN run IS NOT NULL AND (time_stop = 0 OR row_number() OVER (PARTITION BY r.config_id, run ORDER BY bar_idx) <= time_stop) THEN signal ELSE 0 END AS signal FROM ({_g_runs('g_sig')}) r JOIN configs USING (config_id)", "g_sig", "configs")
cte("g_raw", f"SELECT config_id, run, min(bar_idx) AS entry_bar, max(bar_idx) + 1 AS exit_bar, arg_min(signal, bar_idx) AS side, arg_min(close_a, bar_idx) AS raw_entry_a, arg_min(close_b, bar_idx) AS raw_entry_b, arg_max(na, bar_idx) AS raw_exit_a, arg_max(nb, bar_idx) AS raw_exit_b, arg_min(beta, bar_idx) AS beta FROM (SELECT *, lead(close_a) OVER {_gw} AS na, lead(close_b) OVER {_gw} AS nb FROM ({_g_runs('g_stop')})) WHERE run IS NOT NULL GROUP BY config_id, run HAVING max(bar_idx) + 1 < {N_BARS}", "g_stop")
cte("g_trades", price_sql("g_raw"), "g_raw")
cte("g_sum", f"SELECT c.*, trades, win_rate, pnl, profit_factor, avg_pnl FROM (SELECT config_id, count(*) AS trades, 100.0 * avg((pnl_net > 0)::INT) AS win_rate, sum(pnl_net) AS pnl, {PF} AS profit_factor, avg(pnl_net) AS avg_pnl FROM g_trades GROUP BY config_id) JOIN configs c USING (config_id)", "g_trades", "configs")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.run(inputs.hedged(spark, d), grid.axes(spark, **AXES), KEYS)[1]


_MAX = "CASE WHEN n <= 1 THEN m ELSE m + s * (sqrt(2 * ln(n)) - (ln(pi()) + ln(ln(n))) / (2 * sqrt(2 * ln(n)))) END"
cte("trials", "SELECT entry, count(*)::DOUBLE AS n, avg(sharpe) AS m, stddev_pop(sharpe) AS s FROM (SELECT config_id, avg(pnl_net) / nullif(stddev_pop(pnl_net), 0) AS sharpe FROM g_trades GROUP BY config_id) JOIN configs USING (config_id) WHERE sharpe IS NOT NULL GROUP BY entry", "g_trades", "configs")


@register("expected_max_sharpe", query(f"SELECT entry, n, round({_MAX}, 6) AS sharpe FROM trials", "trials"))
def _(spark, d):
    """The best Sharpe ratio to expect by chance of as many trials as the grid has for each entry level, from the trials' mean and spread."""
    done = grid.run(inputs.hedged(spark, d), grid.axes(spark, **AXES), KEYS)[0]
    each = done.groupBy("config_id").agg((F.avg("pnl_net") / F.nullif(F.stddev_pop("pnl_net"), F.lit(0.0))).alias("sharpe"))
    trials = each.filter("sharpe is not null").join(grid.axes(spark, **AXES).select("config_id", "entry"), "config_id")
    found = trials.groupBy("entry").agg(F.count("*").cast("double").alias("n"), F.avg("sharpe").alias("m"), F.stddev_pop("sharpe").alias("s"))
    return found.select("entry", "n", F.round(exprs.expected_max_sharpe(F.col("n"), F.col("m"), F.col("s")), 6).alias("sharpe"))


@register("grid_summary", query(f"SELECT config_id, entry, leave, stop, time_stop, trades, {s6('win_rate', 'pnl', 'profit_factor', 'avg_pnl')} FROM g_sum", "g_sum"))
def _(spark, d):
    return _grid(spark, d).select("config_id", *AXES, "trades", *r6("win_rate", "pnl", "profit_factor", "avg_pnl"))


@register("axis_stability", query("SELECT entry, count(*) AS n, round(avg(pnl), 6) AS mean, round(median(pnl), 6) AS median, round(max(pnl), 6) AS best FROM g_sum GROUP BY entry", "g_sum"))
def _(spark, d):
    return grid.axis_summary(_grid(spark, d), "entry").select("entry", "n", *r6("mean", "median", "best"))


@register("heatmap_pivot", query("SELECT i_entry, " + ", ".join(f"round(median(pnl) FILTER (i_leave = {i}), 6) AS l{i}" for i in range(3)) + " FROM g_sum GROUP BY i_entry", "g_sum"))
def _(spark, d):
    out = grid.heatmap(_grid(spark, d), "i_entry", "i_leave", [0, 1, 2])
    return out.select("i_entry", *(F.round(F.col(str(i)), 6).alias(f"l{i}") for i in range(3)))


@register("tier_filter", query("SELECT config_id, CASE WHEN profit_factor >= 1.3 AND trades >= 20 AND win_rate >= 60 THEN 'A' WHEN profit_factor >= 1.3 AND trades >= 20 THEN 'B' WHEN profit_factor > 1 THEN 'C' ELSE 'D' END AS tier FROM g_sum", "g_sum"))
def _(spark, d):
    return grid.tiers(_grid(spark, d)).select("config_id", "tier")


_AX = ["i_entry", "i_leave", "i_stop", "i_time_stop"]
_STEP = " + ".join(f"abs(a.{x} - b.{x})" for x in _AX)


@register("neighborhood", query(f"SELECT config_id, neighbors, round(pct_good, 6) AS pct_good, round(degradation, 6) AS degradation, pct_good >= 60 AND coalesce(degradation, 0) < 50 AS robust FROM (SELECT a.config_id, count(*) AS neighbors, 100 * avg((b.profit_factor > 1)::INT) AS pct_good, 100 * (any_value(a.profit_factor) - avg(b.profit_factor)) / nullif(any_value(a.profit_factor), 0) AS degradation FROM g_sum a JOIN g_sum b ON {_STEP} = 1 GROUP BY a.config_id)", "g_sum"))
def _(spark, d):
    out = validation.robustness(_grid(spark, d), _AX, "profit_factor")
    number = ((F.col("i_entry") * 3 + F.col("i_leave")) * 2 + F.col("i_stop")) * 2 + F.col("i_time_stop")
    return out.select(number.cast("bigint").alias("config_id"), "neighbors", *r6("pct_good", "degradation"), "robust")


cte("scored", "SELECT *, 0.5 * (pnl - min(pnl) OVER ()) / (max(pnl) OVER () - min(pnl) OVER ()) + 0.5 * (win_rate - min(win_rate) OVER ()) / (max(win_rate) OVER () - min(win_rate) OVER ()) AS score FROM g_sum", "g_sum")


@register("composite_score", query("SELECT config_id, round(score, 6) AS score FROM scored", "scored"))
def _(spark, d):
    return grid.composite(_grid(spark, d), {"pnl": 0.5, "win_rate": 0.5}).select("config_id", *r6("score"))


@register("topk_per_group", query("SELECT entry, config_id, round(pnl, 6) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY pnl DESC, config_id) AS n FROM g_sum) WHERE n <= 3", "g_sum"))
def _(spark, d):
    return grid.best_of(_grid(spark, d), ["entry"], k=3).select("entry", "config_id", *r6("pnl"))


@register("diverse_topk")
def _(spark, d):
    scored = grid.composite(_grid(spark, d), {"pnl": 0.5, "win_rate": 0.5}).select("config_id", *_AX, "score")
    return validation.diverse_topk(spark, scored, _AX, "score", 5)


# --- overlaps ---------------------------------------------------------------------------------
cte("g1", "SELECT * FROM g_trades WHERE config_id = 0", "g_trades")
cte("g2", "SELECT * FROM g_trades WHERE config_id = 16", "g_trades")


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    done = grid.run(inputs.hedged(spark, d), grid.axes(spark, **AXES).filter("config_id in (0, 16)"), KEYS)[0]
    return done.filter("config_id = 0"), done.filter("config_id = 16")


@register("trade_overlap", query("""SELECT (SELECT count(*) FROM g1) AS n1, count(*) AS overlapping, count_if(side1 = side2)::BIGINT AS same_side, round(sum(pnl1), 6) AS pnl FROM
 (SELECT a.entry_bar, any_value(a.side) AS side1, any_value(a.pnl_net) AS pnl1, arg_min(b.side, b.entry_bar) AS side2 FROM g1 a JOIN g2 b ON a.entry_bar < b.exit_bar AND b.entry_bar < a.exit_bar GROUP BY a.entry_bar)""", "g1", "g2"))
def _(spark, d):
    a, b = _two(spark, d)
    return tick_ops.trade_overlap(a, b, KEYS).select("n1", "overlapping", "same_side", *r6("pnl"))


@register("day_overlap", query("SELECT n1, n2, both_days, round(both_days / least(n1, n2), 6) AS share FROM (SELECT (SELECT count(DISTINCT entry_bar) FROM g1) AS n1, (SELECT count(DISTINCT entry_bar) FROM g2) AS n2, (SELECT count(*) FROM (SELECT entry_bar FROM g1 INTERSECT SELECT entry_bar FROM g2)) AS both_days)", "g1", "g2"))
def _(spark, d):
    a, b = _two(spark, d)
    return tick_ops.set_overlap(a, b, "entry_bar").select("n1", "n2", "both_days", *r6("share"))


@register("signal_agreement", query("SELECT a.signal AS one, b.signal AS two, count(*) AS bars FROM (SELECT * FROM g_stop WHERE config_id = 0) a JOIN (SELECT * FROM g_stop WHERE config_id = 16) b USING (bar_idx) GROUP BY 1, 2", "g_stop"))
def _(spark, d):
    from ..operators import signals

    h = inputs.hedged(spark, d)
    a = signals.state_machine(h, 1.0, 0.25, 1.8, KEYS, "bar_idx").select("bar_idx", F.col("signal").cast("int").alias("one"))
    b = signals.state_machine(h, 1.5, 0.5, 1.8, KEYS, "bar_idx").select("bar_idx", F.col("signal").cast("int").alias("two"))
    return a.join(b, "bar_idx").groupBy("one", "two").agg(F.count("*").alias("bars"))


@register("nearest_match", query("SELECT entry_bar, other FROM (SELECT a.entry_bar, b.entry_bar AS other, row_number() OVER (PARTITION BY a.entry_bar ORDER BY abs(a.entry_bar - b.entry_bar), b.entry_bar) AS n FROM g1 a JOIN g2 b ON abs(a.entry_bar - b.entry_bar) <= 2) WHERE n = 1", "g1", "g2"))
def _(spark, d):
    a, b = _two(spark, d)
    return tick_ops.nearest(a, b, KEYS, "entry_bar", 2).select("entry_bar", "other")


# --- whole-series statistics ------------------------------------------------------------------
cte("spread_only", "SELECT bar_idx, spread, zscore, correlation, hurst FROM measured WHERE spread IS NOT NULL", "measured")
_FL = range(2, 21)
_dl = ", ".join(f"spread - lag(spread, {k}) OVER (ORDER BY bar_idx) AS d{k}" for k in _FL)
_ys = " UNION ALL ".join(f"SELECT ln({k}) AS x, ln(stddev_pop(d{k})) AS y FROM lagged" for k in _FL)
cte("lagged", f"SELECT *, {_dl} FROM spread_only", "spread_only")


@register("hurst_full", query(f"SELECT round(greatest(0.01, least(0.99, regr_slope(y, x))), 6) AS hurst FROM ({_ys})", "lagged"))
def _(spark, d):
    return stats.hurst_full(inputs.hedged(spark, d), KEYS, "spread", "bar_idx").select(*r6("hurst"))


cte("ar", "SELECT spread AS y, lag(spread) OVER (ORDER BY bar_idx) AS x FROM spread_only", "spread_only")


@register("halflife_full", query("SELECT round(-ln(2) / ln(regr_slope(y, x)), 6) AS half_life FROM ar", "ar"))
def _(spark, d):
    return stats.halflife_full(inputs.hedged(spark, d), KEYS, "spread", "bar_idx").select(*r6("half_life"))


@register("autocorr", query("SELECT round(corr(y, x), 6) AS acf FROM ar WHERE x IS NOT NULL", "ar"))
def _(spark, d):
    return stats.autocorr(inputs.hedged(spark, d), KEYS, "spread", "bar_idx").select(*r6("acf"))


_rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
cte("ranked", f"SELECT {_rank.format('quant')} AS ra, {_rank.format('price')} AS rb, {_rank.format('tax')} AS rt, flag FROM (SELECT l_quantity AS quant, l_extendedprice AS price, l_tax AS tax, l_returnflag AS flag FROM lineitem)")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit(1).alias("k"), "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_orderkey", "l_linenumber")


@register("spearman", query("SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM ranked", "ranked"))
def _(spark, d):
    return stats.spearman(_items(spark, d), ["k"], "l_quantity", "l_extendedprice").select("n", *r6("rho"))


_residual = ", ".join(f"round(r{c} - i{c} - s{c} * rt, 6) AS {c}" for c in "ab")
_fit = ", ".join(f"regr_slope(r{c}, rt) AS s{c}, regr_intercept(r{c}, rt) AS i{c}" for c in "ab")
cte("residuals", f"SELECT {_residual} FROM ranked, (SELECT {_fit} FROM ranked)", "ranked")


@register("partial_spearman", query(f"SELECT round(corr(a, b), 6) AS rho FROM (SELECT {_rank.format('a')} AS a, {_rank.format('b')} AS b FROM residuals)", "residuals"))
def _(spark, d):
    return stats.partial_spearman(_items(spark, d), ["k"], "l_quantity", "l_extendedprice", "l_tax").select(*r6("rho"))


@register("spearman_within", query("SELECT count(*) AS periods, sum(n)::BIGINT AS n, round(sum(rho * n) / sum(n), 6) AS rho FROM (SELECT y, count(*) AS n, corr(ra, rb) AS rho FROM (SELECT y, " + ", ".join(f"rank() OVER (PARTITION BY y ORDER BY {c}) + (count(*) OVER (PARTITION BY y, {c}) - 1) / 2.0 AS r{k}" for k, c in (("a", "l_quantity"), ("b", "l_extendedprice"))) + " FROM (SELECT *, year(l_shipdate) AS y FROM lineitem)) GROUP BY y) WHERE n >= 10 AND rho IS NOT NULL"))
def _(spark, d):
    """Rank correlation inside each year, averaged by rows."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit(1).alias("k"), F.year("l_shipdate").alias("y"), "l_quantity", "l_extendedprice")
    return stats.spearman_within(items, ["k"], "y", "l_quantity", "l_extendedprice").select("periods", "n", *r6("rho"))


_u = exprs.normal_cdf_sql("((u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) / 12))")


@register("mann_whitney", query(f"SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(1.0 - {_u}, 6) AS p_value FROM (SELECT n1, n2, ties, rs - n1 * (n1 + 1) / 2 AS u FROM (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_extendedprice)), (SELECT sum(rb) FILTER (flag = 'A') AS rs, count_if(flag = 'A')::DOUBLE AS n1, count_if(flag <> 'A')::DOUBLE AS n2 FROM ranked))", "ranked"))
def _(spark, d):
    return stats.mann_whitney(_items(spark, d), ["k"], "l_extendedprice", F.col("l_returnflag") == "A").select("n1", "n2", *r6("u", "p_value"))


@register("jarque_bera", "SELECT any_value(n) AS n, round(any_value(n) / 6 * (avg(((v - m) / s) ** 3) ** 2 + (avg(((v - m) / s) ** 4) - 3) ** 2 / 4), 4) AS jb FROM (SELECT l_extendedprice AS v FROM lineitem), (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)")
def _(spark, d):
    return stats.jarque_bera(_items(spark, d), ["k"], "l_extendedprice").select("n", F.round("jb", 4).alias("jb"))


@register("column_compare", query("SELECT count(*) AS n, round(corr(close_a, close_b), 6) AS r, round(avg(abs(close_a - close_b)), 6) AS mean_diff, round(median(abs(close_a - close_b)), 6) AS median_diff, round(max(abs(close_a - close_b)), 6) AS max_diff, round(100 * avg((abs(close_a - close_b) <= 10)::INT), 6) AS within_0, round(100 * avg((abs(close_a - close_b) <= 50)::INT), 6) AS within_1 FROM aligned", "aligned"))
def _(spark, d):
    return stats.compare(inputs.aligned(spark, d), "close_a", "close_b", [10, 50]).select("n", *r6("r", "mean_diff", "median_diff", "max_diff", "within_0", "within_1"))


_P = ("hurst_median", "adf_pct", "corr_mean", "corr_std", "corr_min", "hl_median", "beta_median", "beta_std")


@register("pair_profile", query(f"SELECT {s6(*_P)}, CASE WHEN hurst_median < 0.5 AND adf_pct > 50 THEN 'GO' WHEN hurst_median < 0.5 OR adf_pct > 25 THEN 'WARN' ELSE 'KILL' END AS verdict FROM (SELECT median(hurst) AS hurst_median, 100 * avg((adf_stat < -2.86)::INT) AS adf_pct, avg(correlation) AS corr_mean, stddev_samp(correlation) AS corr_std, min(correlation) AS corr_min, median(half_life) AS hl_median, median(beta) AS beta_median, stddev_samp(beta) AS beta_std FROM measured)", "measured"))
def _(spark, d):
    return stats.profile(inputs.measured(spark, d), KEYS).select(*r6(*_P), "verdict")


@register("adf_full")
def _(spark, d):
    return stats.adf_full(inputs.hedged(spark, d), KEYS, "spread", "bar_idx").select("pair", *r6("statistic", "p_value"), "lags")


@register("isoos_split", query(f"SELECT bar_idx < floor(n * 0.6) AS in_sample, count(*) AS bars, min(bar_idx) AS lo, max(bar_idx) AS hi FROM aligned, (SELECT count(*) AS n FROM aligned) GROUP BY 1", "aligned"))
def _(spark, d):
    a = inputs.aligned(spark, d)
    n = a.groupBy("pair").agg(F.count("*").alias("n"))
    return a.join(n, "pair").groupBy((F.col("bar_idx") < F.floor(F.col("n") * 0.6)).alias("in_sample")).agg(F.count("*").alias("bars"), F.min("bar_idx").alias("lo"), F.max("bar_idx").alias("hi"))


# --- filters of other families ----------------------------------------------------------------
_KG = "CASE WHEN date_diff('second', lag(ts) OVER (ORDER BY bar_idx), ts) > 1800 THEN 10.0 ELSE 1.0 END"
cte("k_in", f"SELECT bar_idx, ln(close_a) AS la, ln(close_b) AS lb, {_KG} AS g FROM aligned", "aligned")
cte("k_fit", "SELECT regr_slope(la, lb) AS b, regr_intercept(la, lb) AS a FROM k_in WHERE bar_idx < 1000", "k_in")
cte("k_r", "SELECT var_pop(la - a - b * lb) AS r FROM k_in, k_fit WHERE bar_idx < 1000", "k_fit")
cte("kalman", """SELECT -1::BIGINT AS bar_idx, 0.0::DOUBLE AS t0, 1.0::DOUBLE AS t1, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS z, 0.0::DOUBLE AS spread UNION ALL
SELECT bar_idx, t0 + k0 * v, t1 + k1 * v,
 (1 - k0) * ((1 - k0) * p00 - k0 * h * p01) - k0 * h * ((1 - k0) * p01 - k0 * h * p11) + k0 * k0 * r,
 ((1 - k0) * p00 - k0 * h * p01) * (-k1) + ((1 - k0) * p01 - k0 * h * p11) * (1 - k1 * h) + k0 * k1 * r,
 (-k1 * p00 + (1 - k1 * h) * p01) * (-k1) + (-k1 * p01 + (1 - k1 * h) * p11) * (1 - k1 * h) + k1 * k1 * r,
 v / sqrt(f), la - (t1 + k1 * v) * h
FROM (SELECT *, s0 / f AS k0, s1 / f AS k1 FROM (SELECT *, s0 + h * s1 + r AS f FROM (SELECT *, p00 + h * p01 AS s0, p01 + h * p11 AS s1, la - t0 - h * t1 AS v FROM
 (SELECT i.bar_idx, i.la, i.lb AS h, q.r, p.t0, p.t1, p.p00 * i.g + 1e-5 * q.r AS p00, p.p01 * i.g AS p01, p.p11 * i.g + 1e-5 * q.r AS p11 FROM kalman p JOIN k_in i ON i.bar_idx = p.bar_idx + 1, k_r q))))""", "k_in", "k_r")  # fmt: skip


@register("kalman", query("SELECT bar_idx, CASE WHEN bar_idx >= 100 THEN round(t1, 3) END AS beta, CASE WHEN bar_idx >= 100 THEN round(z, 3) END AS zscore, CASE WHEN bar_idx >= 100 THEN round(spread, 2) END AS spread FROM kalman WHERE bar_idx >= 0", "kalman"))
def _(spark, d):
    # every bar of these days begins behind a gap, and the SQL's form of the update is the one that its figures can be met with
    k = kalman.kalman(inputs.aligned(spark, d), KEYS, kalman.KalmanConfig(joseph=True), "bar_idx")
    return k.select("bar_idx", *(F.round(c, n).alias(c) for c, n in (("beta", 3), ("zscore", 3), ("spread", 2))))


# --- inside trades ----------------------------------------------------------------------------
# All bars of all trades of the back-test; mfe_mae_trades and dollar_tpsl_trades below run on ticks.
_PNL = f"side * (n_a * (a.close_a - entry_price_a) * {trades.SPEC['mult_a']} - n_b * (a.close_b - entry_price_b) * {trades.SPEC['mult_b']})"
cte(
    "t_curve",
    f"""SELECT entry_bar, t.pair, side, exit_bar, a.bar_idx, a.ts, a.zscore, {_PNL} AS pnl, row_number() OVER (PARTITION BY entry_bar ORDER BY a.ts) AS i
FROM (SELECT *, 'A_N' AS pair FROM trades) t JOIN hedged a ON a.ts BETWEEN entry_time AND exit_time""",
    "trades",
    "hedged",
)
_T_KEYS = ["pair", "entry_bar"]


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Unrealized PnL at every bar of every trade of the back-test, from the entry to the exit."""
    made = inputs.traded(spark, d).select(*_T_KEYS, "exit_bar", "entry_time", "exit_time", "side", "n_a", "n_b", "entry_price_a", "entry_price_b")
    bar = inputs.hedged(spark, d).select("pair", "bar_idx", "ts", "close_a", "close_b", "zscore")
    met = bars.interval_join(bar, made, "entry_time", "exit_time", ["pair"])
    return met.withColumn("pnl", trades.pnl_gross(*(F.col(c) for c in ("side", "n_a", "n_b", "entry_price_a", "entry_price_b", "close_a", "close_b")), trades.SPEC))


@register(
    "mfe_mae",
    query("SELECT entry_bar, round(max(pnl), 6) AS mfe, round(min(pnl), 6) AS mae, arg_max(ts, pnl) AS mfe_ts, arg_min(ts, pnl) AS mae_ts, count(*) AS ticks FROM t_curve GROUP BY entry_bar", "t_curve"),
)
def _(spark, d):
    return tick_ops.excursions(_curve(spark, d), _T_KEYS).select("entry_bar", *r6("mfe", "mae"), "mfe_ts", "mae_ts", "ticks")


@register("dollar_tpsl", query("""SELECT entry_bar, CASE WHEN tp IS NULL AND sl IS NULL THEN 'NONE' WHEN sl IS NULL OR tp < sl THEN 'TP' ELSE 'SL' END AS touch,
 round(CASE WHEN tp IS NULL AND sl IS NULL THEN final WHEN sl IS NULL OR tp < sl THEN tp_pnl ELSE sl_pnl END, 6) AS pnl
FROM (SELECT entry_bar, min(i) FILTER (pnl >= 150) AS tp, min(i) FILTER (pnl <= -100) AS sl, arg_min(pnl, i) FILTER (pnl >= 150) AS tp_pnl,
 arg_min(pnl, i) FILTER (pnl <= -100) AS sl_pnl, arg_max(pnl, i) AS final FROM t_curve GROUP BY entry_bar)""", "t_curve"))  # fmt: skip
def _(spark, d):
    return tick_ops.first_touch(_curve(spark, d), _T_KEYS, 150.0, 100.0, order=["ts"]).select("entry_bar", "touch", *r6("pnl"))


@register("auto_exit", query("""SELECT entry_bar, min(bar_idx) AS exit_bar, arg_min(why, bar_idx) AS reason
FROM (SELECT *, CASE WHEN side * zscore >= -0.25 THEN 'Z_EXIT' WHEN pnl <= -100 THEN 'DOLLAR_STOP' WHEN bar_idx * 60 % 1440 < 1080 AND bar_idx * 60 % 1440 >= 930 THEN 'TIME_STOP' END AS why
 FROM t_curve WHERE bar_idx > entry_bar) WHERE why IS NOT NULL GROUP BY entry_bar""", "t_curve"))  # fmt: skip
def _(spark, d):
    """The first bar behind its entry at which a live exit rule would close each trade, and which; bars stand for hours of an overnight session."""
    why = trades.auto_exit(F.col("side"), F.col("zscore"), F.col("pnl"), F.col("bar_idx") * 60 % 1440, 0.25, 100.0, 930, (1080, 1020))
    fired = _curve(spark, d).filter("bar_idx > entry_bar").withColumn("reason", why).filter("reason is not null")
    return fired.groupBy(*_T_KEYS).agg(F.min("bar_idx").alias("exit_bar"), F.min_by("reason", "bar_idx").alias("reason")).select("entry_bar", "exit_bar", "reason")


_HYBRID = tick_ops.HybridConfig(entry=1.5, leave=0.5, stop=3.0)


def _two_speed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks (click events with the last view price) and the trades of the two-speed back-test on them, with hourly slow bars."""
    from ..operators import rolling

    t = inputs.ticks(spark, d).withColumn("pair", F.lit("click_view"))
    a = t.filter("instrument = 'click'").select("pair", "ts", F.col("close").alias("a"))
    b = t.filter("instrument = 'view'").select("pair", "ts", F.col("close").alias("b"))
    both = bars.asof(a, b, ["pair"], ["b"]).filter("b is not null")
    hours = bars.resample(inputs.ticks(spark, d), "1 hour", ["instrument"])
    legs = bars.align(hours.filter("instrument = 'click'"), hours.filter("instrument = 'view'"), "click_view")
    slow = rolling.rolling_ols(legs, 20, 10, KEYS)
    slow = rolling.moments(slow, "spread", None, 10, KEYS, prefix="_w_")
    slow = slow.select("pair", "ts", "beta", "alpha", F.col("_w_mean_spread").alias("mean"), F.sqrt("_w_var_spread").alias("std"), "zscore", F.lit(True).alias("gate"))
    return both, tick_ops.hybrid(both, slow, KEYS, _HYBRID)


@register("hybrid_ticks")
def _(spark, d):
    """The two-speed back-test: ticks are click events with the last view price, slow bars are hourly."""
    out = _two_speed(spark, d)[1]
    return out.select("pair", "entry_time", "exit_time", "side", "n_b", *r6("pnl_gross", "costs", "pnl_net", "mfe", "mae"), "exit_reason")


@register("hybrid_summary")
def _(spark, d):
    """The two-speed back-test as a report, with its largest drawdown."""
    return tick_ops.hybrid_summary(_two_speed(spark, d)[1], KEYS)


cte("g_exits", f"SELECT t.config_id, CASE WHEN time_stop > 0 AND exit_bar - entry_bar >= time_stop THEN 'TIME_STOP' WHEN abs(zscore) > stop THEN 'Z_STOP' ELSE 'Z_EXIT' END AS exit_type, pnl_net FROM g_trades t JOIN configs USING (config_id) JOIN hedged ON bar_idx = exit_bar", "g_trades", "configs", "hedged")


@register("grid_exit_types", query("SELECT config_id, exit_type, count(*) AS trades, round(avg(pnl_net), 6) AS avg_pnl FROM g_exits GROUP BY 1, 2", "g_exits"))
def _(spark, d):
    """How the trades of every configuration of a grid ended."""
    h, c = inputs.hedged(spark, d), grid.axes(spark, **AXES)
    done = grid.run(h, c, KEYS)[0].join(F.broadcast(c.select("config_id", "stop", "time_stop")), "config_id")
    met = done.join(h.select("pair", F.col("bar_idx").alias("exit_bar"), "zscore"), ["pair", "exit_bar"])
    timed = (F.col("time_stop") > 0) & (F.col("exit_bar") - F.col("entry_bar") >= F.col("time_stop"))
    kind = F.when(timed, "TIME_STOP").when(F.abs("zscore") > F.col("stop"), "Z_STOP").otherwise("Z_EXIT")
    return met.groupBy("config_id", kind.alias("exit_type")).agg(F.count("*").alias("trades"), F.round(F.avg("pnl_net"), 6).alias("avg_pnl"))


_KINDS = ["Z_EXIT", "Z_STOP", "TIME_STOP"]
_SHARES = ", ".join(
    f"count(*) FILTER (exit_type = '{k}') AS {k.lower()}_count, round(100.0 * count(*) FILTER (exit_type = '{k}') / count(*), 6) AS {k.lower()}_pct,"
    f" coalesce(round(avg(pnl_net) FILTER (exit_type = '{k}'), 4), 0.0) AS {k.lower()}_avg"
    for k in _KINDS
)


@register("exit_breakdown", query(f"SELECT config_id, any_value(entry) AS entry, any_value(stop) AS stop, {_SHARES} FROM g_exits JOIN configs USING (config_id) GROUP BY config_id", "g_exits", "configs"))
def _(spark, d):
    """The maps of every configuration's parameters and exits, read by key."""
    h, c = inputs.hedged(spark, d), grid.axes(spark, **AXES)
    done = grid.run(h, c, KEYS)[0].join(F.broadcast(c.select("config_id", *AXES)), "config_id")
    met = done.join(h.select("pair", F.col("bar_idx").alias("exit_bar"), "zscore"), ["pair", "exit_bar"])
    timed = (F.col("time_stop") > 0) & (F.col("exit_bar") - F.col("entry_bar") >= F.col("time_stop"))
    kind = F.when(timed, "TIME_STOP").when(F.abs("zscore") > F.col("stop"), "Z_STOP").otherwise("Z_EXIT")
    made = validation.exit_breakdown(met.withColumns({"exit_type": kind, "parameters": validation.parameters(["entry", "leave", "stop", "time_stop"])}), ["config_id", "parameters"], _KINDS)
    read = [F.col("exits")[k][f].alias(f"{k.lower()}_{n}") for k in _KINDS for f, n in (("count", "count"), ("pct", "pct"), ("avg_pnl", "avg"))]
    flat = made.select("config_id", F.col("parameters")["entry"].alias("entry"), F.col("parameters")["stop"].alias("stop"), *read)
    return flat.select("config_id", "entry", "stop", *(F.round(c, 4 if c.endswith("avg") else 6).alias(c) if c.endswith(("pct", "avg")) else c for c in flat.columns[3:]))


@register("correlation_p")
def _(spark, d):
    """Linear and rank correlation of two columns with their two-sided p-values."""
    items = _items(spark, d)
    rank = stats.spearman(items, ["k"], "l_quantity", "l_tax").select(F.lit("spearman").alias("kind"), "n", F.col("rho").alias("r"))
    line = stats.pearson(items, ["k"], "l_quantity", "l_tax").select(F.lit("pearson").alias("kind"), "n", "r")
    return rank.unionByName(line).withColumn("p_value", stats.correlation_p("r", "n"))


@register("in_out_rebuilt")
def _(spark, d):
    """Back-tests of the first 70 % of the bars and of the rest, each with estimators of its own."""
    from ..operators import rolling

    n = n_bars(spark, d)
    keys = [*KEYS, "slice"]
    parts = bars.sliced(inputs.aligned(spark, d), KEYS, {"in": (0, 7 * n // 10), "out": (7 * n // 10, n)})
    hedged = rolling.rolling_ols(parts, inputs.OLS, inputs.ZW, keys, "bar_idx", index="bar_idx")
    done = trades.backtest(signals.state_machine(hedged, inputs.ENTRY, LEAVE, STOP, keys, "bar_idx"), keys)
    return trades.summary(done, keys).select("slice", "trades", *r6("win_rate", "pnl", "profit_factor", "avg_pnl"))


_TRADE = ["pair", "entry_time", "exit_time", "side", "n_a", "n_b", "pnl_net"]


def _trade_curve(spark: SparkSession, d: str) -> DataFrame:
    """Unrealized PnL at every tick of every trade of the two-speed back-test, from the entry to the exit."""
    both, made = _two_speed(spark, d)
    met = bars.interval_join(both, made.select(*_TRADE, "entry_price_a", "entry_price_b"), "entry_time", "exit_time", KEYS)
    spec = {"mult_a": _HYBRID.mult_a, "mult_b": _HYBRID.mult_b}
    return met.withColumn("pnl", trades.pnl_gross(F.col("side"), F.col("n_a"), F.col("n_b"), F.col("entry_price_a"), F.col("entry_price_b"), F.col("a"), F.col("b"), spec))


@register("mfe_mae_trades")
def _(spark, d):
    """mfe_mae of all trades of the back-test; the commission of the entry is paid."""
    curve = _trade_curve(spark, d).withColumn("pnl", F.col("pnl") - _HYBRID.commission * (F.col("n_a") + F.col("n_b")))
    return tick_ops.excursions(curve, _TRADE).select("pair", "entry_time", *r6("mfe", "mae"), "mfe_ts", "mae_ts", "ticks")


@register("dollar_tpsl_trades")
def _(spark, d):
    """dollar_tpsl of all trades of the back-test: a touch pays slippage and all commissions, a trade without one keeps its PnL."""
    c, n_a, n_b = _HYBRID, F.col("n_a"), F.col("n_b")
    cost = c.slippage * (c.tick_a * c.mult_a * n_a + c.tick_b * c.mult_b * n_b) + 2 * c.commission * (n_a + n_b)
    got = tick_ops.first_touch(_trade_curve(spark, d), _TRADE, 150.0, 100.0, order=["ts"])
    return got.select("pair", "entry_time", "touch", F.round(F.when(F.col("touch") == "NONE", F.col("pnl_net")).otherwise(F.col("pnl") - cost), 6).alias("pnl"))


@register("stream_replay", query(f"SELECT bar_idx, {s6('zscore')}, signal::INT AS signal FROM signalled", "signalled"))
def _(spark, d):
    """Bars played as a stream give the batch plan's z-scores and signals."""
    import uuid

    from ..sources.storage import shared_dir
    from ..streaming import online

    name = f"replay_{uuid.uuid4().hex}"
    out = online.replay(inputs.aligned(spark, d), f"{shared_dir(spark)}/{name}", name, window=inputs.OLS, z_window=inputs.ZW, entry=inputs.ENTRY, leave=inputs.LEAVE, stop=inputs.STOP)
    return out.select("bar_idx", *r6("zscore"), "signal")
