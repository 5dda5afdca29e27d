"""State machine, filters and trades: hand vectors, and loops on random series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import signals, trades

K = ["pair"]
FREE = {"mult_a": 1.0, "tick_a": 0.0, "mult_b": 1.0, "tick_b": 0.0, "commission": 0.0, "ticks": 0.0}


def series(spark, **cols):
    n = len(next(iter(cols.values())))
    t0 = datetime(2024, 1, 2)
    kinds = {"sig": "int", "zscore": "double", "ok": "boolean"}
    rows = [("p", i, t0 + timedelta(minutes=5 * i), *(None if isinstance(v[i], float) and math.isnan(v[i]) else v[i] for v in cols.values())) for i in range(n)]
    return spark.createDataFrame(rows, "pair string, bar_idx long, ts timestamp_ntz, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))


def out(df, col="signal"):
    return [r[col] for r in df.orderBy("bar_idx").collect()]


nan = math.nan


def walked(z, entry, leave, stop, gate=None):
    """Signals by a loop over bars."""
    got, state = [], 0
    for i, x in enumerate(z):
        state = signals.advance(state, float(x), entry, leave, stop, gate is None or bool(gate[i]))
        got.append((0, 1, -1, 0)[state])
    return got


@pytest.mark.parametrize(("z", "want"), [
    ([0.0, -1, -2.5, -2.3, -1, -0.3, 0], [0, 0, 1, 1, 1, 0, 0]),
    ([0.0, -2.5, -3, -4.5, -2.5, -1, 0.3, -2.5], [0, 1, 1, 0, 0, 0, 0, 1]),
    ([0.0, -2.5, -4.5, nan, -2.5], [0, 1, 0, 0, 1]),
    ([0.0, 2.5, 3, 0.4, 2.1], [0, -1, -1, 0, -1]),
])
def test_machine(spark, z, want):
    assert out(signals.state_machine(series(spark, zscore=[float(x) for x in z]), 2.0, 0.5, 4.0, K, "bar_idx")) == want


@pytest.mark.parametrize("block", [None, 1, 7, 64])
def test_machine_random(spark, block):
    """Equal to the loop, whatever the blocks: missing values, a gate, two keys at the same bars, levels by column."""
    rng = np.random.default_rng(3)
    for leave in (0.0, 0.5, 1.0):
        z = np.cumsum(rng.normal(0, 0.7, 400)) * 0.5
        z[rng.random(400) < 0.03] = nan
        ok = rng.random(400) < 0.6
        df = series(spark, zscore=[float(x) for x in z], ok=[bool(x) for x in ok])
        assert out(signals.state_machine(df, 1.0, leave, 2.5, K, "bar_idx", block=block)) == walked(z, 1.0, leave, 2.5)
        assert out(signals.state_machine(df, 1.0, leave, 2.5, K, "bar_idx", gate="ok", block=block)) == walked(z, 1.0, leave, 2.5, ok)
    two = df.unionByName(df.withColumn("pair", F.lit(None).cast("string")).withColumn("zscore", -F.col("zscore"))).withColumn("e", F.when(F.col("pair").isNull(), 0.8).otherwise(1.0))
    got = signals.state_machine(two, "e", 0.5, 2.5, K, "bar_idx", block=block)
    assert out(got.filter("pair = 'p'")) == walked(z, 1.0, 0.5, 2.5) and out(got.filter("pair is null")) == walked(-z, 0.8, 0.5, 2.5)


def test_machine_in_blocks_of_time(spark):
    z = np.cumsum(np.random.default_rng(4).normal(0, 0.7, 700)) * 0.5
    df = series(spark, zscore=[float(x) for x in z])
    for block in ("hour", "day", None):
        got = [r["signal"] for r in signals.state_machine(df, 1.0, 0.5, 2.5, K, "ts", block=block).orderBy("ts").collect()]
        assert got == walked(z, 1.0, 0.5, 2.5)


def test_prefixes_of_maps():
    steps = np.random.default_rng(1).integers(0, 4, (100, 4)).astype(np.int8)
    got, at = signals.composed(steps), np.arange(4)
    for i in range(100):
        at = steps[i][at]
        assert (got[i] == at).all()


def test_machine_rejects_wide_exit(spark):
    with pytest.raises(ValueError):
        signals.state_machine(series(spark, zscore=[0.0]), 1.0, 2.0, 3.0, K, "bar_idx")


def loop_filter(sig, ok):
    got, state = [], 0
    for s, g in zip(sig, ok, strict=True):
        if s == 0:
            state = 0
        elif state == 0 and g:
            state = 1
        got.append(s if state and s else 0)
    return got


def test_entry_filter(spark):
    sig, ok = [0, 1, 1, 0, -1, -1, 0], [True, False, True, True, True, True, True]
    df = series(spark, sig=sig, ok=ok).withColumnRenamed("sig", "signal")
    assert out(signals.entry_filter(df, F.col("ok"), K, "bar_idx")) == [0, 0, 1, 0, -1, -1, 0]
    rng = np.random.default_rng(5)
    sig, ok = [int(x) for x in rng.choice([-1, 0, 1, 1], 300)], [bool(x) for x in rng.random(300) < 0.3]
    df = series(spark, sig=sig, ok=ok).withColumnRenamed("sig", "signal")
    assert out(signals.entry_filter(df, F.col("ok"), K, "bar_idx")) == loop_filter(sig, ok)


def test_time_stop(spark):
    df = series(spark, sig=[1, 1, 1, 0, -1, -1]).withColumnRenamed("sig", "signal")
    assert out(signals.time_stop(df, 1, K, "bar_idx")) == [1, 0, 0, 0, -1, 0]
    assert out(signals.time_stop(df, 0, K, "bar_idx")) == [1, 1, 1, 0, -1, -1]


def test_trading_window(spark):
    clock = ["03:55", "04:00", "10:00", "13:55", "14:00", "18:00"]
    rows = [("p", i, datetime.fromisoformat(f"2024-01-03 {c}:00"), s) for i, (c, s) in enumerate(zip(clock, [1, 1, -1, 1, -1, 1], strict=True))]
    df = spark.createDataFrame(rows, "pair string, bar_idx long, ts timestamp_ntz, signal int")
    assert out(signals.trading_window(df, 240, 840)) == [0, 1, -1, 1, 0, 0]
    # a position held across the end of entries stays until the flat time
    assert out(signals.window_filter(df.withColumn("signal", F.lit(1)), 240, 840, 930, K, "bar_idx")) == [0, 1, 1, 1, 1, 0]


def traded(spark, a, b, sig, spec=FREE, **options):
    n = len(a)
    df = series(spark, sig=sig, close_a=[float(x) for x in a], close_b=[float(x) for x in b], beta=[1.0] * n).withColumnRenamed("sig", "signal")
    return df, trades.backtest(df, K, spec=spec, **options)


def test_long_and_short(spark):
    r = traded(spark, [100, 100, 102, 102], [200, 200, 201, 201], [0, 1, 1, 0])[1].first()
    assert (r["entry_bar"], r["exit_bar"], r["pnl_net"]) == (1, 3, 1.0)
    assert traded(spark, [100, 100, 98, 98], [200, 200, 199, 199], [0, -1, -1, 0])[1].first()["pnl_net"] == 1.0


def test_costs_and_slippage(spark):
    r = traded(spark, [100] * 4, [200] * 4, [0, 1, 1, 0], FREE | {"commission": 2.5})[1].first()
    assert (r["costs"], r["pnl_gross"], r["pnl_net"]) == (10.0, 0.0, -10.0)
    r = traded(spark, [100] * 4, [200] * 4, [0, 1, 1, 0], FREE | {"tick_a": 0.25, "tick_b": 0.25, "ticks": 1.0})[1].first()
    assert (r["entry_price_a"], r["entry_price_b"], r["exit_price_a"], r["exit_price_b"]) == (100.25, 199.75, 99.75, 200.25)


def test_open_run_is_no_trade_unless_marked(spark):
    assert traded(spark, [1, 2, 3], [1, 1, 1], [0, 1, 1])[1].count() == 0
    assert traded(spark, [1, 2, 3], [1, 1, 1], [0, 1, 1], mark_open=True)[1].first()["exit_bar"] == 2


def test_flip_inside_a_run(spark):
    args = ([1, 2, 3, 4], [1, 1, 1, 1], [1, -1, -1, 0])
    assert traded(spark, *args)[1].count() == 1
    assert [(r["entry_bar"], r["exit_bar"], r["side"]) for r in traded(spark, *args, split_on_flip=True)[1].orderBy("entry_bar").collect()] == [(0, 1, 1), (1, 3, -1)]


def test_dollar_stop(spark):
    r = traded(spark, [100 - 5 * i for i in range(8)], [200] * 8, [0, 0, 1, 1, 1, 1, 1, 0], FREE | {"mult_a": 20.0}, dollar_stop=150.0)[1].first()
    assert (r["entry_bar"], r["exit_bar"]) == (2, 4)


def test_equity(spark):
    df, t = traded(spark, [100, 100, 105, 103], [200] * 4, [0, 1, 1, 0])
    assert out(trades.equity(df, t, K, spec=FREE), "equity") == [100000.0, 100000.0, 100005.0, 100003.0]


def test_summary_and_performance(spark):
    t = spark.createDataFrame([("p", i, i + 1, x) for i, x in enumerate([100.0, 100.0, -50.0, 100.0, -50.0])], "pair string, entry_bar long, exit_bar long, pnl_net double")
    r = trades.summary(t, K).first()
    assert (r["pnl"], r["win_rate"], r["profit_factor"], r["avg_pnl"]) == (200.0, 60.0, 3.0, 40.0)
    assert trades.summary(t.filter("pnl_net > 0"), K).first()["profit_factor"] == math.inf
    curve = spark.createDataFrame([("p", i, x) for i, x in enumerate([100e3, 110e3, 90e3, 95e3, 105e3])], "pair string, bar_idx long, equity double")
    p = trades.performance(curve, t, K).first()
    assert abs(p["max_dd_pct"] - 18.1818) < 1e-3 and p["max_dd_bars"] == 3


def test_confidence_bounds(spark):
    df = spark.createDataFrame([(-3.5, 0.38, 0.92, 30.0), (None, 0.3, 0.9, 30.0), (-1.0, 0.3, 0.9, 30.0), (-3.5, None, None, None)], "adf_stat double, hurst double, correlation double, half_life double")
    assert [round(r[0], 6) for r in df.select(signals.confidence()).collect()] == [100.0, 0.0, 0.0, 40.0]
