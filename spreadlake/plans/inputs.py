"""Stand-ins for market data: legs from unit prices a day and flag, ticks from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, rolling, signals, trades

KEYS = ["pair"]
OLS, ZW, ADF, HURST, HL, CORR = 60, 20, 24, 64, 24, 24
ENTRY, LEAVE, STOP = 1.5, 0.5, 1.8


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, ts, close (mean unit price of a day, to 6 places), volume."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    return rows.groupBy(F.col("l_returnflag").alias("leg"), F.col("l_shipdate").alias("ts")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"), F.sum("l_quantity").alias("volume"))


def aligned(spark: SparkSession, sf_dir: str, a: str = "A", b: str = "N") -> DataFrame:
    both = legs(spark, sf_dir)
    return bars.align(both.filter(F.col("leg") == a), both.filter(F.col("leg") == b), f"{a}_{b}")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type as instrument, ts, open = high = low = close = value, volume 1."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = F.col("value")
    return e.select(F.col("event_type").alias("instrument"), "ts", price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.lit(1.0).alias("volume"))


def hedged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_ols(aligned(spark, sf_dir), OLS, ZW, KEYS, "bar_idx", index="bar_idx")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.all_metrics(hedged(spark, sf_dir), KEYS, "bar_idx", ADF, HURST, HL, CORR, index="bar_idx")


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.state_machine(hedged(spark, sf_dir), ENTRY, LEAVE, STOP, KEYS, "bar_idx")


def traded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return trades.backtest(signalled(spark, sf_dir), KEYS, **options)


def traded_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traded(spark, sf_dir)


SQL: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    SQL[name], NEEDS[name] = body, list(needs)


def query(final: str, *needs: str) -> str:
    """final behind the common table expressions that it needs, each after its own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in NEEDS[name]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + final if order else final


def rows(n: int, end: int = 0, by: str = "bar_idx") -> str:
    stop = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(ORDER BY {by} ROWS BETWEEN {n - 1 - end} PRECEDING AND {stop})"


cte("legs", "SELECT l_returnflag AS leg, l_shipdate AS ts, round(avg(l_extendedprice / l_quantity), 6) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2")
cte("aligned", "SELECT 'A_N' AS pair, row_number() OVER (ORDER BY a.ts) - 1 AS bar_idx, a.ts, a.close AS close_a, b.close AS close_b, a.volume AS volume_a, b.volume AS volume_b FROM legs a JOIN legs b ON a.ts = b.ts AND a.leg = 'A' AND b.leg = 'N'", "legs")
cte("ticks", "SELECT event_type AS instrument, ts, value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM events")
_w = rows(OLS)
cte("ols", f"SELECT *, CASE WHEN count(*) OVER {_w} = {OLS} THEN covar_samp(la, lb) OVER {_w} / nullif(var_samp(lb) OVER {_w}, 0) END AS beta, avg(la) OVER {_w} AS ma, avg(lb) OVER {_w} AS mb FROM (SELECT *, ln(close_a) AS la, ln(close_b) AS lb FROM aligned)", "aligned")
cte("spreads", "SELECT *, ma - beta * mb AS alpha, la - beta * lb - (ma - beta * mb) AS spread FROM ols", "ols")
_z = rows(ZW)
cte("hedged", f"SELECT *, CASE WHEN count(spread) OVER {_z} = {ZW} THEN (spread - avg(spread) OVER {_z}) / nullif(stddev_samp(spread) OVER {_z}, 0) END AS zscore FROM spreads", "spreads")
cte("pairs_", "SELECT *, spread - lag(spread) OVER (ORDER BY bar_idx) AS d, CASE WHEN spread IS NOT NULL THEN lag(spread) OVER (ORDER BY bar_idx) END AS l FROM hedged", "hedged")
_a = rows(ADF - 1, -1)
cte("adf_sums", f"SELECT *, count(d) OVER {_a} AS c, sum(d) OVER {_a} AS sd, sum(l) OVER {_a} AS sl, sum(d * l) OVER {_a} AS sdl, sum(l * l) OVER {_a} AS sll, sum(d * d) OVER {_a} AS sdd FROM pairs_", "pairs_")
cte("adf_parts", "SELECT *, CASE WHEN sll - sl * sl / nullif(c, 0) > 0 THEN sll - sl * sl / nullif(c, 0) END AS sxx, sdl - sd * sl / nullif(c, 0) AS sxy, sdd - sd * sd / nullif(c, 0) AS syy FROM adf_sums", "adf_sums")
cte("adf", f"SELECT *, CASE WHEN bar_idx >= {ADF} AND c >= 10 AND (syy - sxy * sxy / sxx) / nullif(c - 2, 0) > 0 THEN sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (c - 2) / sxx) END AS adf_stat FROM adf_parts", "adf_parts")
_lags = rolling.hurst_lags(HURST)
cte("hurst_d", "SELECT *, " + ", ".join(f"spread - lag(spread, {k}) OVER (ORDER BY bar_idx) AS d{k}" for k in _lags) + " FROM adf", "adf")
cte("hurst_t", "SELECT *, " + ", ".join(f"CASE WHEN count(d{k}) OVER {rows(HURST - k)} = {HURST - k} THEN stddev_samp(d{k}) OVER {rows(HURST - k)} END AS t{k}" for k in _lags) + " FROM hurst_d", "hurst_d")
cte("hurst_y", "SELECT *, " + ", ".join(f"CASE WHEN t{k} > 1e-12 THEN ln(t{k}) END AS y{k}" for k in _lags) + " FROM hurst_t", "hurst_t")
_n = " + ".join(f"(y{k} IS NOT NULL)::INT" for k in _lags)
_sx = " + ".join(f"CASE WHEN y{k} IS NULL THEN 0 ELSE ln({k}) END" for k in _lags)
_sxx = " + ".join(f"CASE WHEN y{k} IS NULL THEN 0 ELSE ln({k}) * ln({k}) END" for k in _lags)
_sy = " + ".join(f"coalesce(y{k}, 0)" for k in _lags)
_sxy = " + ".join(f"coalesce(y{k} * ln({k}), 0)" for k in _lags)
cte("hurst_s", f"SELECT *, {_n} AS hn, {_sx} AS hx, {_sxx} AS hxx, {_sy} AS hy, {_sxy} AS hxy FROM hurst_y", "hurst_y")
cte("hurst", f"SELECT *, last_value(CASE WHEN bar_idx >= {HURST} AND hn >= 3 THEN greatest(0.01, least(0.99, (hn * hxy - hx * hy) / nullif(hn * hxx - hx * hx, 0))) END IGNORE NULLS) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS hurst FROM hurst_s", "hurst_s")
_h = rows(HL - 1)
cte("hl_b", f"SELECT *, CASE WHEN count(CASE WHEN spread IS NOT NULL AND l IS NOT NULL THEN 1 END) OVER {_h} = {HL - 1} THEN covar_samp(spread, l) OVER {_h} / nullif(var_samp(l) OVER {_h}, 0) END AS hb FROM hurst", "hurst")
cte("hl", "SELECT *, last_value(CASE WHEN hb > 0 AND hb < 1 THEN -ln(2) / ln(hb) END IGNORE NULLS) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS half_life FROM hl_b", "hl_b")
_c = rows(CORR)
cte("measured", f"SELECT *, CASE WHEN count(*) OVER {_c} = {CORR} THEN covar_samp(la, lb) OVER {_c} / nullif(sqrt(var_samp(la) OVER {_c} * var_samp(lb) OVER {_c}), 0) END AS correlation FROM hl", "hl")
cte(
    "states",
    f"""SELECT bar_idx, zscore, 0 AS s FROM hedged WHERE bar_idx = 0 UNION ALL
SELECT h.bar_idx, h.zscore, CASE WHEN h.zscore IS NULL THEN 0
 WHEN p.s = 0 THEN CASE WHEN h.zscore < -{ENTRY} THEN 1 WHEN h.zscore > {ENTRY} THEN 2 ELSE 0 END
 WHEN p.s = 1 THEN CASE WHEN h.zscore > -{LEAVE} THEN 0 WHEN h.zscore < -{STOP} THEN 3 ELSE 1 END
 WHEN p.s = 2 THEN CASE WHEN h.zscore < {LEAVE} THEN 0 WHEN h.zscore > {STOP} THEN 3 ELSE 2 END
 ELSE CASE WHEN abs(h.zscore) < {LEAVE} THEN 0 ELSE 3 END END
FROM states p JOIN hedged h ON h.bar_idx = p.bar_idx + 1""",
    "hedged",
)
cte("signalled", "SELECT h.*, (CASE s WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::TINYINT AS signal FROM hedged h JOIN states USING (bar_idx)", "hedged", "states")


def runs_sql(source: str) -> str:
    return f"SELECT *, CASE WHEN signal <> 0 THEN sum(start_) OVER (ORDER BY bar_idx) END AS run FROM (SELECT *, (signal <> 0 AND coalesce(lag(signal) OVER (ORDER BY bar_idx), 0) = 0)::INT AS start_ FROM {source})"


def filter_sql(source: str, allowed: str) -> str:
    """CTE body of a delayed entry: inside a run the signal shows from the first allowed bar on."""
    return f"SELECT * EXCLUDE (signal, run, start_), (CASE WHEN run IS NOT NULL AND max((coalesce({allowed}, false))::INT) OVER (PARTITION BY run ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) = 1 THEN signal ELSE 0 END)::TINYINT AS signal FROM ({runs_sql(source)})"


def trades_sql(source: str) -> str:
    """CTE body of raw trades of a signal's runs."""
    return f"""SELECT run, min(bar_idx) AS entry_bar, max(bar_idx) + 1 AS exit_bar, min(ts) AS entry_time, max(nts) AS exit_time, arg_min(signal, bar_idx) AS side,
 arg_min(close_a, bar_idx) AS raw_entry_a, arg_min(close_b, bar_idx) AS raw_entry_b, arg_max(na, bar_idx) AS raw_exit_a, arg_max(nb, bar_idx) AS raw_exit_b, arg_min(beta, bar_idx) AS beta
FROM (SELECT *, lead(ts) OVER (ORDER BY bar_idx) AS nts, lead(close_a) OVER (ORDER BY bar_idx) AS na, lead(close_b) OVER (ORDER BY bar_idx) AS nb FROM ({runs_sql(source)})) WHERE run IS NOT NULL GROUP BY run HAVING max(nts) IS NOT NULL AND arg_max(nts IS NOT NULL, bar_idx)"""


def price_sql(source: str, ticks: str = "1.0") -> str:
    s = trades.SPEC
    return f"""SELECT *, pnl_gross - costs AS pnl_net FROM (SELECT *, side * (n_a * (exit_price_a - entry_price_a) * {s['mult_a']} - n_b * (exit_price_b - entry_price_b) * {s['mult_b']}) AS pnl_gross, {s['commission']} * (n_a + n_b) * 2 AS costs
FROM (SELECT *, 1 AS n_a, coalesce(greatest(round_even(raw_entry_a * {s['mult_a']} / nullif(raw_entry_b * {s['mult_b']}, 0) * abs(coalesce(beta, 1)) * 1, 0), 1), 1)::INT AS n_b,
 raw_entry_a + side * {ticks} * {s['tick_a']} AS entry_price_a, raw_entry_b - side * {ticks} * {s['tick_b']} AS entry_price_b, raw_exit_a - side * {ticks} * {s['tick_a']} AS exit_price_a, raw_exit_b + side * {ticks} * {s['tick_b']} AS exit_price_b FROM {source}))"""


cte("raw_trades", trades_sql("signalled"), "signalled")
cte("trades", price_sql("raw_trades"), "raw_trades")
PF = "CASE WHEN coalesce(sum(CASE WHEN pnl_net <= 0 THEN -pnl_net END), 0) > 0 THEN coalesce(sum(CASE WHEN pnl_net > 0 THEN pnl_net END), 0) / sum(CASE WHEN pnl_net <= 0 THEN -pnl_net END) WHEN coalesce(sum(CASE WHEN pnl_net > 0 THEN pnl_net END), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END"
_m = trades.SPEC
cte(
    "equity",
    f"""SELECT bar_idx, ts, 100000.0 + coalesce((SELECT sum(pnl_net) FROM trades t WHERE t.exit_bar <= h.bar_idx), 0)
 + coalesce((SELECT sum(side * (n_a * (h.close_a - entry_price_a) * {_m['mult_a']} - n_b * (h.close_b - entry_price_b) * {_m['mult_b']})) FROM trades t WHERE h.bar_idx >= t.entry_bar AND h.bar_idx < t.exit_bar), 0) AS equity FROM hedged h""",
    "hedged", "trades",
)
