"""Registered queries that go through sources and sinks: what they write to the shared folder is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation
from ..sources import files
from ..sources.storage import shared_dir
from . import estimators, inputs
from .inputs import KEYS, query
from .queries import r6, register, s6
from .queries_validation import _grid


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _vendor_file(spark: SparkSession, d: str) -> str:
    """Clicks as a vendor's file of ticks: a column for the day, one for the time, prices and a volume."""
    t = inputs.ticks(spark, d).filter("instrument = 'click'")
    path = _folder(spark, "vendor")
    price = [F.col("close").alias(f" {c}") for c in ("Open", "High", "Low", "Last")]
    t.select(F.date_format("ts", "y/M/d").alias("Date"), F.date_format("ts", "H:m:s").alias(" Time"), *price, F.lit(1).alias(" Volume")).write.option("header", True).csv(path)
    return path


@register("vendor_scan", query("SELECT 'click' AS instrument, date_trunc('second', ts) AS ts, value AS open, value AS close, 1.0::DOUBLE AS volume FROM events WHERE event_type = 'click'"))
def _(spark, d):
    """Vendor files, written and scanned again."""
    return files.vendor_csv(spark, _vendor_file(spark, d), "click").select("instrument", "ts", "open", "close", "volume")


@register("ticks_of_days", query("SELECT date_trunc('second', ts) AS ts, value AS last FROM events WHERE event_type = 'click' AND ts::DATE IN (SELECT ts::DATE FROM events WHERE event_type = 'purchase' AND value > 250)"))
def _(spark, d):
    """Ticks of the days on which a purchase over 250 stands for an open trade."""
    opened = inputs.ticks(spark, d).filter("instrument = 'purchase' and close > 250").select(F.col("ts").alias("entry_time"), F.col("ts").alias("exit_time"))
    return files.ticks_for_days(spark, _vendor_file(spark, d), opened, "click").select("ts", "last")


@register("pair_cache", query("SELECT pair, bar_idx, ts, close_a, close_b FROM aligned", "aligned"))
def _(spark, d):
    """Aligned legs by way of the cache of their configuration."""
    config, folder = {"pair": "A_N", "every": "1 day"}, _folder(spark, "cache")
    files.write_cache(inputs.aligned(spark, d), folder, config, ["pair"])
    return files.read_cache(spark, folder, config).select("pair", "bar_idx", "ts", "close_a", "close_b")


@register("grid_store", query(f"SELECT config_id, trades, {s6('pnl')} FROM g_sum WHERE time_stop = 0", "g_sum"))
def _(spark, d):
    """A grid's summaries, stored by time stop; the scan reads one folder and three columns."""
    path = _folder(spark, "grid")
    files.write_grid(_grid(spark, d), path, ["time_stop"])
    return files.read_grid(spark, path).filter("time_stop = 0").select("config_id", "trades", *r6("pnl"))


@register("stored_outputs", query("SELECT count(*) AS trades, round(sum(pnl_net), 4) AS pnl FROM trades", "trades"))
def _(spark, d):
    """The back-test's trades by way of its output files."""
    made = inputs.traded(spark, d).select("entry_bar", "exit_bar", "side", "pnl_net")
    path = _folder(spark, "outputs")
    files.write_outputs(path, made, made.select("exit_bar", "pnl_net"), made.agg(F.count("*").alias("trades")))
    back: DataFrame = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/trades")
    return back.agg(F.count("*").alias("trades"), F.round(F.sum("pnl_net"), 4).alias("pnl"))


@register("estimator_by_name", query(f"SELECT bar_idx, {s6('beta', 'zscore')} FROM hedged", "hedged"))
def _(spark, d):
    """The hedge by the registry's name for it."""
    made = estimators.create("ols_rolling", KEYS, window=inputs.OLS, z_window=inputs.ZW)(inputs.aligned(spark, d))
    return made.select("bar_idx", *r6("beta", "zscore"))


@register("adf_every_fifth", query(f"SELECT bar_idx, round(last_value(CASE WHEN bar_idx >= {inputs.ADF} AND (bar_idx - {inputs.ADF}) % 5 = 0 THEN adf_stat END IGNORE NULLS) OVER (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), 6) AS adf_stat FROM adf", "adf"))
def _(spark, d):
    """The statistic on each fifth bar, carried forward between."""
    from ..operators import rolling

    return rolling.rolling_adf(inputs.hedged(spark, d), inputs.ADF, KEYS, "bar_idx", step=5, index="bar_idx").select("bar_idx", *r6("adf_stat"))


@register("grades", query("SELECT config_id, CASE WHEN profit_factor >= 1.2 THEN 'GO' WHEN profit_factor >= 1 THEN 'WARN' ELSE 'KILL' END AS grade FROM g_sum", "g_sum"))
def _(spark, d):
    return _grid(spark, d).select("config_id", validation.grade(F.col("profit_factor"), 1.2, 1.0).alias("grade"))


@register("daily_pnl_by_entry", query("SELECT entry_time::DATE::VARCHAR AS day, round(sum(pnl_net), 6) AS pnl, count(*) AS trades FROM trades GROUP BY 1", "trades"))
def _(spark, d):
    found = validation.daily_pnl(inputs.traded(spark, d), KEYS, "entry_time")
    return found.select(F.col("day").cast("string").alias("day"), *r6("pnl"), "trades")


@register("best_trades", query(f"SELECT entry_bar, {s6('pnl_net')} FROM trades ORDER BY trades.pnl_net DESC, entry_bar LIMIT 20", "trades"))
def _(spark, d):
    """The twenty best trades (a top-k report)."""
    return inputs.traded(spark, d).orderBy(F.desc("pnl_net"), "entry_bar").limit(20).select("entry_bar", *r6("pnl_net"))


