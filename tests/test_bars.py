"""Bars: session bounds, cleaning, resampling, as-of joins, sources."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import bars, rolling
from spreadlake.sources import files

T0 = datetime(2024, 1, 3, 18, 0)  # a Wednesday


def frame(spark, rows, cols="instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double"):
    return spark.createDataFrame(rows, cols)


def bar(ts, close=1.0, volume=1.0):
    return ("X", ts, close, close, close, close, volume)


@pytest.mark.parametrize(("clock", "kept"), [("17:59", False), ("18:00", True), ("23:59", True), ("00:00", True), ("14:59", True), ("15:00", False), ("15:30", False)])
def test_session(spark, clock, kept):
    df = frame(spark, [bar(datetime.fromisoformat(f"2024-01-03 {clock}:00"))])
    assert (df.filter(bars.in_session(F.col("ts"), 1050, 930, 30)).count() == 1) == kept


def test_clean_fills_three_rows_and_no_more(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    df = frame(spark, [bar(at(0), 1.0), bar(at(4), 2.0), bar(at(9), 3.0), bar(at(10), 9.0, 0.0), bar(datetime(2024, 1, 6, 18, 1))])
    got = {r["ts"]: r["close"] for r in bars.clean(df, ["instrument"], 1050, 930).collect()}
    assert [got.get(at(m)) for m in range(10)] == [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, None, 3.0]
    assert not any(t.weekday() > 4 for t in got)


def test_resample_keeps_a_partial_bin(spark):
    df = frame(spark, [bar(T0 + timedelta(minutes=m), float(m)) for m in range(7)])
    got = [(r["ts"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars.resample(df, "5 minutes", ["instrument"]).orderBy("ts").collect()]
    assert got == [(T0, 0.0, 4.0, 0.0, 4.0, 5.0), (T0 + timedelta(minutes=5), 5.0, 6.0, 5.0, 6.0, 2.0)]


def test_asof_takes_equal_times(spark):
    left = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(minutes=5), 2), ("b", T0, 3)], "k string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([("a", T0, 10.0), ("a", T0 + timedelta(minutes=6), 20.0)], "k string, ts timestamp_ntz, v double")
    assert {r["i"]: r["v"] for r in bars.asof(left, right, ["k"], ["v"]).collect()} == {1: 10.0, 2: 10.0, 3: None}


def test_align_numbers_in_time_order(spark):
    a = spark.createDataFrame([(T0 + timedelta(days=i), float(i), 1.0) for i in (2, 0, 1)], "ts timestamp_ntz, close double, volume double")
    b = a.filter("close <> 1")
    assert [(r["bar_idx"], r["close_a"]) for r in bars.align(a, b, "p").orderBy("bar_idx").collect()] == [(0, 0.0), (1, 2.0)]
    assert bars.null_legs(bars.align(a, b, "p")).count() == 0


def by_frames(x, y, n):
    """mean, variance and covariance of each full frame of finite values."""
    out = []
    for i in range(len(x)):
        a, b = x[max(0, i - n + 1) : i + 1], y[max(0, i - n + 1) : i + 1]
        ok = len(a) == n and np.isfinite(a).all() and np.isfinite(b).all()
        out.append((a.mean(), a.var(ddof=1), b.var(ddof=1), np.cov(a, b)[0, 1]) if ok else None)
    return out


@pytest.mark.parametrize("block", [64, 4096])
@pytest.mark.parametrize("n", [2, 20, 64, 65, 150])
def test_frames_with_missing_and_non_finite_values(spark, monkeypatch, block, n):
    """Any length of frame, on one path: a null, a NaN and an infinity void the frames that hold them, and no others."""
    monkeypatch.setattr(rolling, "BLOCK", block)
    rng = np.random.default_rng(n)
    x, y = 1e4 + np.cumsum(rng.normal(size=900)), 50 + np.cumsum(rng.normal(size=900))
    x[217], x[218], y[600] = np.nan, np.inf, -np.inf
    given = [("p", i, None if i in (37, 38) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    x[37:39] = np.nan
    df = spark.createDataFrame(given, "pair string, ts int, x double, y double")
    for index in (None, "ts"):
        got = rolling.moments(df, "x", "y", n, ["pair"], index=index).orderBy("ts").collect()
        for r, want in zip(got, by_frames(x, y, n), strict=True):
            made = tuple(r[c] for c in ("m_mean_x", "m_var_x", "m_var_y", "m_cov"))
            assert made == (None,) * 4 if want is None else np.allclose(made, want, rtol=1e-7, atol=1e-9)
    assert sum(w is not None for w in by_frames(x, y, n)) > 200


def test_error_does_not_grow_with_the_series(spark):
    """The last frames of a long series far from where it began, against the same rows alone."""
    n = 60_000
    x = np.linspace(0, 1e6, n) + np.random.default_rng(1).normal(size=n) * 1e-3
    df = spark.range(n).selectExpr("'p' AS pair", "id AS ts")
    df = df.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ts long, x double"), "ts")
    got = rolling.moments(df, "x", None, 30, ["pair"], index="ts").filter(f"ts >= {n - 50}").orderBy("ts").collect()
    for i, r in enumerate(got):
        assert abs(r["m_var_x"] / x[n - 50 + i - 29 : n - 50 + i + 1].var(ddof=1) - 1) < 1e-6


def test_a_series_is_several_tasks(spark):
    df = spark.range(50_000).selectExpr("'p' AS pair", "id AS ts", "sin(id) AS x")
    made = rolling.moments(df, "x", None, 30, ["pair"], index="ts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_are_numbered_by_units_of_time(spark):
    t = [datetime(2024, 1, 30) + timedelta(hours=7 * i) for i in range(200)]
    df = spark.createDataFrame([(k, x) for k in ("a", None) for x in t], "k string, ts timestamp_ntz").repartition(3)
    got = {(r["k"], r["ts"]): r["n"] for r in rolling.numbered(df, ["k"], out="n").collect()}
    assert got == {(k, x): i for k in ("a", None) for i, x in enumerate(t)}


def test_constant_window_has_no_value(spark):
    df = spark.createDataFrame([("p", i, 5.0, 5.0) for i in range(40)], "pair string, ts int, close_a double, close_b double")
    got = rolling.rolling_corr(rolling.rolling_ols(df, 10, 5, ["pair"]), 10, ["pair"]).collect()
    assert all(r["beta"] is None and r["zscore"] is None and r["correlation"] is None for r in got)


def test_interval_join_keeps_keys_apart(spark):
    """Two pairs at the same times, spans from a second to 300 days, bounds that are met exactly, null keys and times."""
    rng = np.random.default_rng(2)
    t = [T0 + timedelta(minutes=7 * i) for i in range(3000)]
    ticks = [(k, x) for k in ("p", "q", None) for x in t]
    spans = []
    for i, k in enumerate(["p", "q"] * 12):
        lo = T0 + timedelta(seconds=int(rng.integers(-10**5, 10**6)))
        spans.append((i, k, lo, lo + timedelta(seconds=int(4.0 ** rng.integers(0, 11)))))
    spans += [(90, "p", t[5], t[5]), (91, "q", t[9], t[10]), (92, "p", T0 - timedelta(days=100), T0 + timedelta(days=200)), (93, None, t[0], t[9]), (94, "p", t[9], t[3]), (95, "p", None, t[3])]
    got = bars.interval_join(spark.createDataFrame(ticks, "pair string, ts timestamp_ntz"), spark.createDataFrame(spans, "i int, pair string, lo timestamp_ntz, hi timestamp_ntz"), "lo", "hi", ["pair"])
    want = sorted((i, k, x) for i, k, lo, hi in spans if lo and k for x in t if lo <= x <= hi)
    assert sorted((r["i"], r["pair"], r["ts"]) for r in got.collect()) == want and len(want) > 3000


def test_a_long_span_lies_in_few_bins(spark):
    one = spark.createDataFrame([("p", T0, T0 + timedelta(days=300))], "pair string, lo timestamp_ntz, hi timestamp_ntz")
    seen = bars.interval_join(spark.createDataFrame([("p", T0)], "pair string, ts timestamp_ntz"), one, "lo", "hi", ["pair"])
    assert seen.count() == 1
    width = F.expr("shiftleft(60000000L, 2 * cast(ceil(log(4, 300 * 1440)) as int))")
    assert one.select((F.floor(F.unix_micros(F.col("hi").cast("timestamp")) / width) - F.floor(F.unix_micros(F.col("lo").cast("timestamp")) / width)).alias("n")).first()["n"] <= 1


def test_vendor_csv(spark, tmp_path):
    (tmp_path / "NQ_data.csv").write_text("Date, Time, Open, High, Low, Last, Volume, NumberOfTrades\n2024/1/3, 9:05:00, 1, 2, 0.5, 1.5, 10, 3\n2024/01/03, 09:06:00, x, NaN, 1, , 5, 1\nbad, 1, 1, 1, 1, 1, 1, 1\n")
    got = files.vendor_csv(spark, str(tmp_path / "NQ_data.csv")).orderBy("ts").collect()
    assert [(r["instrument"], r["ts"], r["open"], r["close"], r["num_trades"]) for r in got] == [("NQ", datetime(2024, 1, 3, 9, 5), 1.0, 1.5, 3.0), ("NQ", datetime(2024, 1, 3, 9, 6), None, None, 1.0)]


def test_ticks_for_days(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Date,Time,Last\n2024/1/3,9:05:00,1\n2024/1/4,9:05:00,2\n2024/1/5,9:05:00,3\n")
    trades = spark.createDataFrame([(datetime(2024, 1, 4, 1), datetime(2024, 1, 5, 1))], "entry_time timestamp_ntz, exit_time timestamp_ntz")
    assert sorted(r["last"] for r in files.ticks_for_days(spark, str(tmp_path / "t.csv"), trades).collect()) == [2.0, 3.0]


def test_indicator_tsv(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\tSpread\tRolling\nDate Time\tZ-Score\tHurst Exp\n2024-01-03  10:05:00\t1.5\t0.4\n2024-01-03  10:00:00\t\t0.5\n")
    got = files.indicator_tsv(spark, str(tmp_path / "x.txt"), {"z": "z-score", "h": "hurst", "none": "nope"}).orderBy("ts").collect()
    assert [(r["ts"].minute, r["z"], r["h"], r["none"]) for r in got] == [(0, None, 0.5, None), (5, 1.5, 0.4, None)]


def test_cache_depends_on_configuration(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "pair string, x int")
    files.write_cache(df, str(tmp_path), {"buffer": 0}, ["pair"])
    assert files.read_cache(spark, str(tmp_path), {"buffer": 0}).count() == 1
    assert files.read_cache(spark, str(tmp_path), {"buffer": 30}) is None


def test_contracts(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"instruments": {"NQ": {"exchange": "X", "multiplier": 20, "tick_size": 0.25}}}')
    t = files.contracts(spark, str(tmp_path / "c.json"))
    assert files.contract(t, "NQ")["multiplier"] == 20.0
    with pytest.raises(KeyError):
        files.contract(t, "ZZ")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    files.write_outputs(str(tmp_path / "o"), df, df, df)
    files.write_grid(df, str(tmp_path / "g"), ["a"])
    assert files.read_grid(spark, str(tmp_path / "g"), ["b"]).columns == ["b"]
    assert "<table" in open(files.write_report(str(tmp_path / "r"), {"t": df})).read()
