"""Registered queries of reports: derived parameters, votes, sweeps, calendars, set operations, matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import rolling, signals, ticks as tick_ops, trades
from . import grid, inputs
from .inputs import ENTRY, KEYS, LEAVE, STOP, cte, price_sql, query
from .queries import r6, register, s6
from .queries_validation import _grid, _two, gated_sql


@register("derived_levels", query("SELECT config_id, trades, round(greatest(entry - leave, 0), 4) AS z_exit, round(entry + stop, 4) AS z_stop FROM g_sum", "g_sum"))
def _(spark, d):
    """Exit and stop levels, from steps off the entry level, of the configurations that traded."""
    levels = F.round(F.greatest(F.col("entry") - F.col("leave"), F.lit(0.0)), 4).alias("z_exit"), F.round(F.col("entry") + F.col("stop"), 4).alias("z_stop")
    return _grid(spark, d).select("config_id", "trades", *levels)


@register("profile_filter", query("SELECT config_id FROM g_sum WHERE trades BETWEEN 50 AND 400 AND win_rate >= 50 AND profit_factor > 1 AND avg_pnl > 0 AND entry >= 1 AND leave <= 0.5 AND stop < 5", "g_sum"))
def _(spark, d):
    return _grid(spark, d).filter(F.col("trades").between(50, 400) & (F.col("win_rate") >= 50) & (F.col("profit_factor") > 1) & (F.col("avg_pnl") > 0) & (F.col("entry") >= 1) & (F.col("leave") <= 0.5) & (F.col("stop") < 5)).select("config_id")


@register("filter_vote", query("SELECT config_id, ((trades >= 100)::INT + (win_rate >= 60)::INT + (profit_factor > 1.2)::INT + (avg_pnl > 0)::INT)::INT AS votes FROM g_sum WHERE (trades >= 100)::INT + (win_rate >= 60)::INT + (profit_factor > 1.2)::INT + (avg_pnl > 0)::INT >= 3", "g_sum"))
def _(spark, d):
    votes = sum((c.cast("int") for c in (F.col("trades") >= 100, F.col("win_rate") >= 60, F.col("profit_factor") > 1.2, F.col("avg_pnl") > 0)), F.lit(0))
    return _grid(spark, d).withColumn("votes", votes).filter("votes >= 3").select("config_id", "votes")


_LABEL = "CASE WHEN entry >= 1.7 THEN 'far' WHEN leave <= 0.25 AND stop > 2 OR time_stop > 0 THEN 'patient' ELSE 'plain' END"


def _label():
    return F.when(F.col("entry") >= 1.7, "far").when((F.col("leave") <= 0.25) & (F.col("stop") > 2) | (F.col("time_stop") > 0), "patient").otherwise("plain")


@register("config_label", query(f"SELECT {_LABEL} AS label, count(*) AS n, sum(trades)::BIGINT AS trades, round(max(pnl), 6) AS best_pnl FROM g_sum GROUP BY 1", "g_sum"))
def _(spark, d):
    """Configurations that traded by label, with their trades and best PnL."""
    return _grid(spark, d).groupBy(_label().alias("label")).agg(F.count("*").alias("n"), F.sum("trades").alias("trades"), F.round(F.max("pnl"), 6).alias("best_pnl"))


_BEST = "ORDER BY pnl DESC, config_id"
cte("topn_all", f"SELECT *, row_number() OVER (PARTITION BY label {_BEST}) AS by_label, row_number() OVER (PARTITION BY entry, leave {_BEST}) AS by_levels FROM (SELECT *, {_LABEL} AS label FROM g_sum)", "g_sum")
cte("topn_first", f"SELECT * FROM topn_all WHERE by_label = 1 {_BEST} LIMIT 5", "topn_all")
cte("topn_both", "SELECT 0 AS turn, * FROM topn_first UNION ALL SELECT 1, * FROM topn_all t WHERE by_levels = 1 AND NOT EXISTS (SELECT 1 FROM topn_first f WHERE f.entry = t.entry AND f.leave = t.leave)", "topn_all", "topn_first")


@register("pattern_topn", query("SELECT label, config_id, round(pnl, 6) AS pnl FROM topn_both ORDER BY turn, pnl DESC, config_id LIMIT 5", "topn_both"))
def _(spark, d):
    """Five configurations: the best of each label, then the best of levels that none of them has."""
    return grid.diverse_best(_grid(spark, d).withColumn("label", _label()), ["label"], ["entry", "leave"], 5).select("label", "config_id", *r6("pnl"))


@register("dedup_best", query("SELECT entry, leave, config_id FROM (SELECT *, row_number() OVER (PARTITION BY entry, leave ORDER BY pnl DESC, config_id) AS n FROM (SELECT * FROM g_sum WHERE stop < 2 UNION ALL SELECT * FROM g_sum WHERE time_stop = 0)) WHERE n = 1", "g_sum"))
def _(spark, d):
    """Two candidate lists together, one row for each pair of levels, the best."""
    g = _grid(spark, d)
    return grid.best_of(g.filter("stop < 2").unionByName(g.filter("time_stop = 0")), ["entry", "leave"]).select("entry", "leave", "config_id")


@register("time_stop_sweep", query("SELECT b.config_id, round(a.pnl - b.pnl, 6) AS gain, a.pnl > b.pnl AND a.trades >= 0.8 * b.trades AS better FROM g_sum a JOIN g_sum b ON a.i_entry = b.i_entry AND a.i_leave = b.i_leave AND a.i_stop = b.i_stop AND a.time_stop = 3 AND b.time_stop = 0", "g_sum"))
def _(spark, d):
    g = _grid(spark, d).select("config_id", "i_entry", "i_leave", "i_stop", "time_stop", "pnl", "trades")
    base = g.filter("time_stop = 0").withColumnsRenamed({"pnl": "p0", "trades": "t0"}).drop("time_stop")
    with_stop = g.filter("time_stop = 3").drop("time_stop", "config_id")
    met = with_stop.join(base, ["i_entry", "i_leave", "i_stop"])
    return met.select("config_id", F.round(F.col("pnl") - F.col("p0"), 6).alias("gain"), ((F.col("pnl") > F.col("p0")) & (F.col("trades") >= 0.8 * F.col("t0"))).alias("better"))


@register("halflife_time_stop", query("SELECT k, ceil(median(half_life) * k)::BIGINT AS bars FROM measured, (SELECT unnest([1, 2, 3])::INT AS k) GROUP BY k", "measured"))
def _(spark, d):
    m = inputs.measured(spark, d).agg(F.median("half_life").alias("m"))
    return m.crossJoin(F.broadcast(spark.range(1, 4).select(F.col("id").cast("int").alias("k")))).select("k", F.ceil(F.col("m") * F.col("k")).alias("bars"))


_SIZES = [("mini", 20.0, 5.0, 1), ("micro", 2.0, 0.5, 1), ("micro2", 2.0, 0.5, 2)]
_size_sql = " UNION ALL ".join(f"SELECT '{n}' AS contract, sum(side * (({a} * {k}) * (exit_price_a - entry_price_a) - ({b} * {k}) * n_b * (exit_price_b - entry_price_b)) - costs * {k}) AS pnl FROM trades" for n, a, b, k in _SIZES)


@register("contract_sizes", query(f"SELECT contract, round(pnl, 6) AS pnl FROM ({_size_sql})", "trades"))
def _(spark, d):
    sizes = F.broadcast(spark.createDataFrame(_SIZES, "contract string, ma double, mb double, k int"))
    live = F.col("side") * (F.col("ma") * F.col("k") * (F.col("exit_price_a") - F.col("entry_price_a")) - F.col("mb") * F.col("k") * F.col("n_b") * (F.col("exit_price_b") - F.col("entry_price_b"))) - F.col("costs") * F.col("k")
    return inputs.traded(spark, d).crossJoin(sizes).groupBy("contract").agg(F.round(F.sum(live), 6).alias("pnl"))


_windows = [12, 24, 48]


def _corr_sql(n: int) -> str:
    w = inputs.rows(n)
    return f"SELECT {n}::INT AS frame_bars, h.bar_idx, CASE WHEN count(*) OVER {w} = {n} THEN covar_samp(la, lb) OVER {w} / nullif(sqrt(var_samp(la) OVER {w} * var_samp(lb) OVER {w}), 0) END AS correlation FROM hedged h"


_gate_rows = " UNION ALL ".join(f"SELECT frame_bars, bar_idx, correlation > 0.1 AS ok FROM ({_corr_sql(n)})" for n in _windows)
cte("window_trades", price_sql(f"({gated_sql(_gate_rows, 'frame_bars')})"), "hedged", "signalled")


@register("gate_window_sensitivity", query("SELECT frame_bars, count(*) AS trades, round(sum(pnl_net), 6) AS pnl FROM window_trades GROUP BY frame_bars", "window_trades"))
def _(spark, d):
    """The back-test under a correlation gate, run again for each window of the correlation."""
    s = inputs.signalled(spark, d)
    s = s if "la" in s.columns else s.withColumns({"la": F.ln("close_a"), "lb": F.ln("close_b")})
    parts = [rolling.rolling_corr(s, n, KEYS, "bar_idx", index="bar_idx").withColumn("frame_bars", F.lit(n)) for n in _windows]
    gated = signals.entry_filter(reduce(DataFrame.unionByName, parts), F.col("correlation") > 0.1, [*KEYS, "frame_bars"], "bar_idx")
    done = trades.backtest(gated, [*KEYS, "frame_bars"])
    return done.groupBy("frame_bars").agg(F.count("*").alias("trades"), F.round(F.sum("pnl_net"), 6).alias("pnl"))


_WEIGHTS = [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)]
_abl = " UNION ALL ".join(f"SELECT {i}::INT AS combo, config_id, {a} * win_rate + {b} * profit_factor AS score FROM g_sum" for i, (a, b) in enumerate(_WEIGHTS))


@register("weight_ablation", query(f"SELECT config_id, arg_max(combo, score) AS best_combo, round(stddev_samp(score) / avg(score), 6) AS cv FROM ({_abl}) GROUP BY config_id", "g_sum"))
def _(spark, d):
    w = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(_WEIGHTS)], "combo int, a double, b double"))
    s = _grid(spark, d).crossJoin(w).withColumn("score", F.col("a") * F.col("win_rate") + F.col("b") * F.col("profit_factor"))
    return s.groupBy("config_id").agg(F.max_by("combo", "score").alias("best_combo"), F.round(F.stddev_samp("score") / F.avg("score"), 6).alias("cv"))


# --- calendars --------------------------------------------------------------------------------
@register("hour_weekday_heatmap", query("SELECT hour(ts)::INT AS hour, " + ", ".join(f"round(avg(close) FILTER (isodow(ts) = {i + 1}), 6) AS d{i}" for i in range(7)) + " FROM ticks GROUP BY 1", "ticks"))
def _(spark, d):
    t = inputs.ticks(spark, d).withColumns({"hour": F.hour("ts"), "day": F.concat(F.lit("d"), F.weekday("ts"))})
    return t.groupBy("hour").pivot("day", [f"d{i}" for i in range(7)]).agg(F.round(F.avg("close"), 6))


cte("monthly", "SELECT strftime(ts, '%Y-%m') AS period, arg_max(close_a, ts) AS close FROM aligned GROUP BY 1", "aligned")


@register("period_change", query("SELECT period, round(close, 6) AS close, round(close - lag(close) OVER (ORDER BY period), 6) AS diff, round(close / lag(close) OVER (ORDER BY period) - 1, 6) AS pct FROM monthly", "monthly"))
def _(spark, d):
    m = inputs.aligned(spark, d).groupBy("pair", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.max_by("close_a", "ts").alias("close"))
    before = F.lag("close").over(Window.partitionBy("pair").orderBy("period"))
    return m.select("period", *r6("close"), F.round(F.col("close") - before, 6).alias("diff"), F.round(F.col("close") / before - 1, 6).alias("pct"))


@register("yearly_drift", query("SELECT year(ts)::INT AS year, round(arg_max(spread, bar_idx) - arg_min(spread, bar_idx), 6) AS drift, count(*) AS bars FROM hedged WHERE spread IS NOT NULL GROUP BY 1", "hedged"))
def _(spark, d):
    h = inputs.hedged(spark, d).filter("spread is not null")
    return h.groupBy(F.year("ts").alias("year")).agg(F.round(F.max_by("spread", "bar_idx") - F.min_by("spread", "bar_idx"), 6).alias("drift"), F.count("*").alias("bars"))


def _equity(spark: SparkSession, d: str) -> DataFrame:
    s = inputs.signalled(spark, d)
    return trades.equity(s, trades.backtest(s, KEYS), KEYS)


cte("eq_step", "SELECT bar_idx, ts, equity - coalesce(lag(equity) OVER (ORDER BY bar_idx), equity) AS step FROM equity", "equity")


@register("equity_period_pnl", query("SELECT strftime(ts, '%Y-%m') AS period, round(sum(step), 6) AS pnl FROM eq_step GROUP BY 1 HAVING abs(sum(step)) > 0.01", "eq_step"))
def _(spark, d):
    """PnL of each period from equity; the first bar counts from the equity of the bar before."""
    e = _equity(spark, d)
    step = e.withColumn("step", F.col("equity") - F.coalesce(F.lag("equity").over(rolling.ordered(KEYS, "bar_idx")), F.col("equity")))
    return step.groupBy(F.date_format("ts", "yyyy-MM").alias("period")).agg(F.sum("step").alias("pnl")).filter(F.abs("pnl") > 0.01).select("period", *r6("pnl"))


@register("equity_daily_pnl", query("SELECT day::VARCHAR AS day, round(close - coalesce(lag(close) OVER (ORDER BY day), 100000.0), 6) AS pnl FROM (SELECT ts::DATE AS day, arg_max(equity, bar_idx) AS close FROM equity GROUP BY 1)", "equity"))
def _(spark, d):
    """What the equity's last value of a day gained on the day before's; the first day on the capital."""
    days = _equity(spark, d).groupBy("pair", F.to_date("ts").alias("day")).agg(F.max_by("equity", "bar_idx").alias("close"))
    before = F.coalesce(F.lag("close").over(Window.partitionBy("pair").orderBy("day")), F.lit(100_000.0))
    return days.select(F.col("day").cast("string").alias("day"), F.round(F.col("close") - before, 6).alias("pnl"))


@register("equity_yearly_pnl", query("SELECT year(ts)::INT AS year, round(arg_max(equity, bar_idx) - arg_min(equity, bar_idx), 6) AS pnl FROM equity GROUP BY 1 HAVING count(*) >= 10", "equity"))
def _(spark, d):
    e = _equity(spark, d).groupBy(F.year("ts").alias("year")).agg((F.max_by("equity", "bar_idx") - F.min_by("equity", "bar_idx")).alias("pnl"), F.count("*").alias("n"))
    return e.filter("n >= 10").select("year", *r6("pnl"))


@register("bar_returns", query("SELECT bar_idx, round(coalesce(equity / lag(equity) OVER (ORDER BY bar_idx) - 1, 0), 8) AS r FROM equity", "equity"))
def _(spark, d):
    before = F.lag("equity").over(rolling.ordered(KEYS, "bar_idx"))
    return _equity(spark, d).select("bar_idx", F.round(F.coalesce(exprs.div(F.col("equity"), before) - 1, F.lit(0.0)), 8).alias("r"))


# --- policies and matches ---------------------------------------------------------------------
@register("zscore_zero_policy", query("SELECT bar_idx, round(coalesce(zscore, 0), 6) AS zscore FROM hedged", "hedged"))
def _(spark, d):
    return rolling.rolling_ols(inputs.aligned(spark, d), inputs.OLS, inputs.ZW, KEYS, "bar_idx", null_z="zero", index="bar_idx").select("bar_idx", *r6("zscore"))


cte(
    "gated_states",
    f"""SELECT bar_idx, 0 AS s FROM measured WHERE bar_idx = 0 UNION ALL
SELECT h.bar_idx, CASE WHEN h.zscore IS NULL THEN 0
 WHEN p.s = 0 THEN CASE WHEN coalesce(h.correlation > 0.1, false) AND h.zscore < -{ENTRY} THEN 1 WHEN coalesce(h.correlation > 0.1, false) AND h.zscore > {ENTRY} THEN 2 ELSE 0 END
 WHEN p.s = 1 THEN CASE WHEN h.zscore > -{LEAVE} THEN 0 WHEN h.zscore < -{STOP} THEN 3 ELSE 1 END
 WHEN p.s = 2 THEN CASE WHEN h.zscore < {LEAVE} THEN 0 WHEN h.zscore > {STOP} THEN 3 ELSE 2 END
 ELSE CASE WHEN abs(h.zscore) < {LEAVE} THEN 0 ELSE 3 END END FROM gated_states p JOIN measured h ON h.bar_idx = p.bar_idx + 1""",
    "measured",
)


@register("inner_gate_machine", query("SELECT bar_idx, (CASE s WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::TINYINT AS signal FROM gated_states", "gated_states"))
def _(spark, d):
    """The machine whose FLAT state has the gate inside."""
    m = inputs.measured(spark, d).withColumn("ok", F.col("correlation") > 0.1)
    return signals.state_machine(m, ENTRY, LEAVE, STOP, KEYS, "bar_idx", gate="ok").select("bar_idx", "signal")


@register("set_operations", query("SELECT 'both' AS part, count(*) AS bars FROM (SELECT entry_bar FROM g1 INTERSECT SELECT entry_bar FROM g2) UNION ALL SELECT 'one', count(*) FROM (SELECT entry_bar FROM g1 EXCEPT SELECT entry_bar FROM g2) UNION ALL SELECT 'any', count(*) FROM (SELECT entry_bar FROM g1 UNION SELECT entry_bar FROM g2)", "g1", "g2"))
def _(spark, d):
    a, b = (x.select("entry_bar") for x in _two(spark, d))
    parts = [("both", a.intersect(b)), ("one", a.subtract(b)), ("any", a.union(b).distinct())]
    out = [df.agg(F.count("*").alias("bars")).select(F.lit(n).alias("part"), "bars") for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("closest_same_month", query("SELECT a.entry_bar, arg_min(b.entry_bar, {'d': abs(a.entry_bar - b.entry_bar), 'b': b.entry_bar}) AS other FROM g1 a JOIN hedged ha ON ha.bar_idx = a.entry_bar, g2 b JOIN hedged hb ON hb.bar_idx = b.entry_bar WHERE a.side = b.side AND strftime(ha.ts, '%Y-%m') = strftime(hb.ts, '%Y-%m') GROUP BY a.entry_bar", "g1", "g2", "hedged"))
def _(spark, d):
    """Of the other list's trades of the same month and side the nearest."""
    a, b = (x.select("entry_bar", "side", F.date_format("entry_time", "yyyy-MM").alias("month")) for x in _two(spark, d))
    met = a.join(b.withColumnRenamed("entry_bar", "o"), ["side", "month"])
    return met.groupBy("entry_bar").agg(F.min_by("o", F.struct(F.abs(F.col("entry_bar") - F.col("o")).alias("d"), "o")).alias("other"))


@register("greedy_match")
def _(spark, d):
    """One-to-one matches of the entries of two back-tests within two bars."""
    return tick_ops.greedy_match(*_two(spark, d), KEYS, 2)


@register("near_equal_lookup", query("SELECT config_id FROM configs WHERE abs(entry - 1.5000000001) <= 1e-8 + 1e-5 * 1.5 AND abs(leave - 0.5) <= 1e-8 + 1e-5 * 0.5", "configs"))
def _(spark, d):
    """Look-up of a configuration by levels that are nearly equal."""
    from .queries_validation import AXES

    near = lambda c, v: F.abs(F.col(c) - v) <= 1e-8 + 1e-5 * abs(v)
    return grid.axes(spark, **AXES).filter(near("entry", 1.5000000001) & near("leave", 0.5)).select("config_id")


@register("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
