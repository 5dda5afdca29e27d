"""Bars: session filters, cleaning, resampling, alignment and time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import seconds_of_day
from .rolling import ffill, ordered

VALUES = ["open", "high", "low", "close", "volume"]


def in_session(ts: Column, start: int, end: int, buffer_minutes: int = 0) -> Column:
    """Overnight session start..end in minutes of the day, narrowed by a buffer at either side."""
    t = seconds_of_day(ts)
    return (t >= 60 * (start + buffer_minutes)) | (t < 60 * (end - buffer_minutes))


def in_window(ts: Column, start: int, end: int) -> Column:
    """[start, end) in minutes of the day."""
    t = seconds_of_day(ts)
    return (t >= 60 * start) & (t < 60 * end)


def clean(bars: DataFrame, keys: list[str], start: int, end: int, buffer_minutes: int = 0, most: int = 3, minutes: int = 1) -> DataFrame:
    """Session rows with volume, on a grid of whole minutes from Monday to Friday, gaps of at most `most` rows filled.

    The grid of each key is generated from its first and last time, so keys are cleaned in parallel.
    """
    values = [c for c in bars.columns if c not in (*keys, "ts")]
    kept = bars.filter(in_session(F.col("ts"), start, end, buffer_minutes) & (F.col("volume") > 0))
    spans = kept.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spans.select(*keys, F.explode(F.expr(f"sequence(date_trunc('MINUTE', lo)::timestamp_ntz, hi, interval {minutes} minute)")).alias("ts")).filter(F.weekday("ts") < 5)
    joined = grid.join(kept, [*keys, "ts"], "left")
    filled = joined.select(*keys, "ts", *(ffill(F.col(c), keys, most=most).alias(c) for c in values))
    return filled.filter(F.col("close").isNotNull() & in_session(F.col("ts"), start, end, buffer_minutes))


def resample(bars: DataFrame, every: str, keys: list[str]) -> DataFrame:
    """Open, high, low, close and summed volumes of left-closed, left-labelled bins; empty bins are dropped."""
    extra = [c for c in ("num_trades", "bid_vol", "ask_vol") if c in bars.columns]
    out = bars.groupBy(*keys, F.window("ts", every).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *(F.sum(c).alias(c) for c in ("volume", *extra))
    )
    return out.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", *extra)


def align(a: DataFrame, b: DataFrame, pair: str) -> DataFrame:
    """Inner join of two legs (ts, close, volume) on time, numbered in time order."""
    one = a.select("ts", F.col("close").alias("close_a"), F.col("volume").alias("volume_a"))
    two = b.select("ts", F.col("close").alias("close_b"), F.col("volume").alias("volume_b"))
    joined = one.join(two, "ts").withColumn("pair", F.lit(pair))
    number = F.row_number().over(ordered(["pair"])) - 1
    return joined.select("pair", number.cast("bigint").alias("bar_idx"), "ts", "close_a", "close_b", "volume_a", "volume_b")


def null_legs(aligned: DataFrame) -> DataFrame:
    """Quality query: rows in which a leg is missing; alignment promises none."""
    return aligned.filter(F.greatest(*(F.col(c).isNull() for c in ("close_a", "close_b"))))


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts", block: str | None = None) -> DataFrame:
    """left with the last values of right at or before each time: one union and one window, no range join.

    block: a unit of date_trunc (such as `day`).  The window is then one of a key and block, so a key's
    rows spread over tasks; what the blocks before end with comes from a table of one row a key and block.
    """
    if block:
        cut = lambda df: df.withColumn("_block", F.date_trunc(block, F.col(ts).cast("timestamp")))
        at = [*keys, "_block"]
        inside = asof(cut(left), cut(right).withColumn("_met", F.lit(True)), at, [*values, "_met"], ts)
        ends = cut(right).groupBy(*at).agg(F.max_by(F.struct(*values), ts).alias("_end"))
        every = cut(left).select(*at).distinct().join(ends, at, "full")
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        carried = every.select(*at, before.alias("_before"))
        joined = inside.join(carried, at, "left")
        return joined.select(*left.columns, *(F.when(F.col("_met"), F.col(c)).otherwise(F.col(f"_before.{c}")).alias(c) for c in values))
    mark = right.select(*keys, ts, *values, F.lit(0).alias("_side"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, ts)))
    both = left.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values), F.lit(1).alias("_side")).unionByName(mark)
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("_held", held).filter("_side = 1").select(*left.columns, *(F.col(f"_held.{c}").alias(c) for c in values))


def union_ffill(a: DataFrame, b: DataFrame, key: str, col_a: str, col_b: str) -> DataFrame:
    """All times of two series with both values carried forward; rows before both have one are dropped."""
    both = a.join(b, [key, "ts"], "full_outer")
    return both.select(key, "ts", ffill(F.col(col_a), [key]).alias(col_a), ffill(F.col(col_b), [key]).alias(col_b)).filter(F.col(col_a).isNotNull() & F.col(col_b).isNotNull())


MINUTE = 60_000_000  # microseconds
WIDEST = 18


def interval_join(ticks: DataFrame, spans: DataFrame, start: str, end: str, keys: list[str], tick_ts: str = "ts") -> DataFrame:
    """Ticks of a key inside [start, end] of each of its spans, as an equi-join on keys, class and bin.

    Spans fall into classes by length, each with bins four times as wide as the class before (from a minute on), so a
    span, however long, lies in two bins of its class or so; a tick is looked up once in each class that occurs (at most
    WIDEST + 1, a table that is broadcast).  Null keys and times join nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.expr(f"shiftleft({MINUTE}L, 2 * _class)")
    steps = F.greatest(micros(end) - micros(start), F.lit(MINUTE)) / MINUTE
    known = spans.filter(F.col(start) <= F.col(end)).withColumn("_class", F.least(F.ceil(F.log(4.0, steps)), F.lit(WIDEST)).cast("int"))
    binned = known.withColumn("_bin", F.explode(F.sequence(F.floor(micros(start) / width), F.floor(micros(end) / width))))
    classes = F.broadcast(known.select("_class").distinct())
    looked = ticks.crossJoin(classes).withColumn("_bin", F.floor(micros(tick_ts) / width))
    return looked.join(binned, [*keys, "_class", "_bin"]).filter(F.col(tick_ts).between(F.col(start), F.col(end))).drop("_class", "_bin")


def sliced(df: DataFrame, keys: list[str], cuts: dict[str, tuple[int, int]], order: str = "bar_idx") -> DataFrame:
    """Rows of each named slice [lo, hi) of bars, with the name in `slice` and bars numbered from 0: with it as a key, estimators start anew."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in cuts.items())))
    met = df.withColumn("_s", named).filter((F.col(order) >= F.col("_s.lo")) & (F.col(order) < F.col("_s.hi")))
    return met.withColumns({"slice": F.col("_s.slice"), order: F.col(order) - F.col("_s.lo")}).drop("_s")


def session_starts(df: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """df with session_start: the gap to the row before exceeds `minutes`."""
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(ordered(keys)).cast("timestamp"))
    return df.withColumn("session_start", F.coalesce(gap > 60 * minutes, F.lit(False)))
