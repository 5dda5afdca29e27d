"""Signals: state machine, entry filters, masks and confidence."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import linear_score, minute_of_day, trapezoid_score
from .rolling import ordered
from .walk import in_order


def advance(state: int, z: float, entry: float, leave: float, stop: float, gate: bool = True) -> int:
    """Next of FLAT 0, LONG 1, SHORT 2, COOLDOWN 3; a missing z makes it FLAT, a closed gate only keeps FLAT from opening."""
    if z != z:
        return 0
    if state == 0:
        return (1 if z < -entry else 2 if z > entry else 0) if gate else 0
    if state == 3:
        return 0 if abs(z) < leave else 3
    inward = z if state == 1 else -z  # how far the spread is from a long position's loss
    return 0 if inward > -leave else 3 if inward < -stop else state


BLOCK = 1 << 14


def steps_of(z: np.ndarray, entry: np.ndarray, leave: np.ndarray, stop: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """What each bar does, as a map: [i, state before] is the state after it (see advance)."""
    out = np.zeros((len(z), 4), np.int8)  # a missing z leads to FLAT from everywhere
    known = ~np.isnan(z)
    with np.errstate(invalid="ignore"):
        out[:, 0] = np.where(known & gate, np.where(z < -entry, 1, np.where(z > entry, 2, 0)), 0)
        out[:, 1] = np.where(known & ~(z > -leave), np.where(z < -stop, 3, 1), 0)
        out[:, 2] = np.where(known & ~(-z > -leave), np.where(-z < -stop, 3, 2), 0)
        out[:, 3] = np.where(known & ~(np.abs(z) < leave), 3, 0)
    return out


def composed(steps: np.ndarray) -> np.ndarray:
    """[i, state before the first bar] -> state after bar i: all prefixes of a block, in log2 passes over it."""
    out, far = steps, 1
    while far < len(out):
        out = np.concatenate([out[:far], np.take_along_axis(out[far:], out[:-far], axis=1)])
        far *= 2
    return out


_PLACES = np.array([1, 4, 16, 64], np.int16)  # a map of four states, two bits each


def state_machine(df: DataFrame, entry: float | str, leave: float | str, stop: float | str, keys: list[str], order: str = "ts", z: str = "zscore", gate: str | None = None, block: int | str | None = None) -> DataFrame:
    """df with signal in -1, 0, 1.  gate: a boolean column that FLAT needs to open (the machine's own gate,
    which asks for |z| beyond the entry level on the bar that opens).  A level is a number, or the name of a column.

    A bar maps four states to four states, and maps compose, so a series is walked in blocks, each on its own:
    all states that a block can start in are carried through it at once.  A table of one row a block gives each
    block's start, and a row's state is then a look-up in its map.  block: rows of `order` that make a block, or for
    times a unit of date_trunc; by default 16,384 or a month.
    """
    if not isinstance(leave, str) and not isinstance(entry, str) and leave > entry:
        raise ValueError("the exit level must not exceed the entry level")
    times = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    part = F.date_trunc(block or "month", F.col(order).cast("timestamp")) if times else F.floor(F.col(order) / (block or BLOCK))
    levels = {k: F.col(v).cast("double") if isinstance(v, str) else F.lit(float(v)) for k, v in (("_entry", entry), ("_leave", leave), ("_stop", stop))}
    rows = df.withColumns({**levels, "_z": F.coalesce(F.col(z).cast("double"), F.lit(math.nan)), "_open": F.coalesce(F.col(gate), F.lit(False)) if gate else F.lit(True), "_part": part})
    names = df.columns

    def start():
        before = np.arange(4, dtype=np.int8)[None]  # what the block's rows so far do

        def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            z, a, b, c, ok = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_z", "_entry", "_leave", "_stop", "_open"))
            made = composed(steps_of(z, a, b, c, ok))
            made = np.take_along_axis(made, np.repeat(before, len(made), axis=0), axis=1)
            before = made[-1:]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "_part"]), pa.array((made * _PLACES).sum(axis=1).astype(np.int16))], [*names, "_part", "_map"])

        return walk

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    kind = rows.schema["_part"].dataType.simpleString()
    mapped = in_order(rows, [*keys, "_part"], [order], start, f"{schema}, _part {kind}, _map smallint")
    whole = mapped.groupBy(*keys, "_part").agg(F.max_by("_map", order).alias("_map"))

    def chain():
        state = 0

        def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal state
            begins = []
            for m in batch.column("_map").to_pylist():
                begins.append(state)
                state = m >> 2 * state & 3
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, "_part"]), pa.array(begins, pa.int32())], [*(f"_k{i}" for i in range(len(keys))), "_p", "_begin"])

        return walk

    key_kinds = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    begins = in_order(whole, keys, ["_part"], chain, f"{key_kinds}, _p {kind}, _begin int")
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    state = F.expr("shiftright(_map, 2 * _begin) & 3")
    return mapped.join(begins, same).select(*names, F.when(state == 1, 1).when(state == 2, -1).otherwise(0).cast("tinyint").alias("signal"))


def with_runs(df: DataFrame, keys: list[str], order: str = "ts", signal: str = "signal", split_on_flip: bool = False) -> DataFrame:
    """df with _run: the number of the block of non-zero signals that a row is in (NULL outside)."""
    at = ordered(keys, order)
    before = F.coalesce(F.lag(signal).over(at), F.lit(0))
    starts = (F.col(signal) != 0) & ((before == 0) | (F.lit(split_on_flip) & (before != F.col(signal))))
    number = F.sum(starts.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_starts", starts).withColumn("_run", F.when(F.col(signal) != 0, number)).drop("_starts")


def entry_filter(df: DataFrame, allowed: Column, keys: list[str], order: str = "ts", signal: str = "signal") -> DataFrame:
    """Delays entries until `allowed` holds (a missing value doesn't); exits are never blocked."""
    runs = with_runs(df.withColumn("_ok", F.coalesce(allowed, F.lit(False)).cast("int")), keys, order, signal)
    w = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max("_ok").over(w) == 1
    return runs.withColumn(signal, F.when(F.col("_run").isNotNull() & opened, F.col(signal)).otherwise(0).cast("tinyint")).select(*df.columns)


def time_stop(df: DataFrame, most: int | str, keys: list[str], order: str = "ts", signal: str = "signal") -> DataFrame:
    """Rows behind the first `most` (a number, or a column's name) of a run become 0; 0 turns the stop off."""
    if not isinstance(most, str) and most <= 0:
        return df
    limit = F.col(most) if isinstance(most, str) else F.lit(most)
    runs = with_runs(df, keys, order, signal)
    nth = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    return runs.withColumn("_n", nth).withColumn(signal, F.when(F.col("_run").isNotNull() & ((limit <= 0) | (F.col("_n") <= limit)), F.col(signal)).otherwise(0).cast("tinyint")).select(*df.columns)


def window_filter(df: DataFrame, start: int, end: int, flat: int, keys: list[str], order: str = "ts", signal: str = "signal") -> DataFrame:
    """Entries only in [start, end) minutes of the day; no position at `flat` or later, nor before start."""
    m = minute_of_day(F.col("ts"))
    forced = df.withColumn(signal, F.when((m >= flat) | (m < start), 0).otherwise(F.col(signal)).cast("tinyint"))
    return entry_filter(forced, (m >= start) & (m < end), keys, order, signal)


def trading_window(df: DataFrame, start: int, end: int, signal: str = "signal") -> DataFrame:
    m = minute_of_day(F.col("ts"))
    return df.withColumn(signal, F.when((m >= start) & (m < end), F.col(signal)).otherwise(0).cast("tinyint"))


def metric_gate(metric: str, op: str, level: float) -> Column:
    """One gate: metric below (`lt`) or above (`gt`) a level; missing blocks."""
    if op not in ("lt", "gt"):
        raise ValueError(f"unknown gate {op}")
    return F.coalesce(F.col(metric) < level if op == "lt" else F.col(metric) > level, F.lit(False))


def regime_mask(columns: list[str], hurst: float = 0.45, corr: float = 0.80, adf: float = -2.86, hl: tuple[float, float] = (5, 120)) -> Column:
    """All tests of the metrics that are present; a missing value fails."""
    tests = {"hurst": F.col("hurst") < hurst, "correlation": F.col("correlation") > corr, "adf_stat": F.col("adf_stat") < adf, "half_life": F.col("half_life").between(*hl)}
    out = F.lit(True)
    for name, test in tests.items():
        if name in columns:
            out = out & F.coalesce(test, F.lit(False))
    return out


def gate_mask(adf: float = -2.86, hurst: float = 0.50, corr: float = 0.70) -> Column:
    return F.coalesce((F.col("adf_stat") < adf) & (F.col("hurst") < hurst) & (F.col("correlation") > corr), F.lit(False))


#: Fixed values: (worst, best) of the linear scores, the trapezoid of the half-life, weights, and the gate.
CONFIDENCE = {"adf": (-1.0, -3.5), "hurst": (0.52, 0.38), "corr": (0.65, 0.92), "hl": (3.0, 10.0, 60.0, 200.0), "weights": (0.40, 0.25, 0.20, 0.15), "gate": -1.0}


def confidence(cfg: dict = CONFIDENCE) -> Column:
    """0 to 100; 0 where the ADF statistic is missing or not under the gate."""
    w = cfg["weights"]
    total = w[0] * linear_score(F.col("adf_stat"), *cfg["adf"]) + w[1] * linear_score(F.col("hurst"), *cfg["hurst"]) + w[2] * linear_score(F.col("correlation"), *cfg["corr"]) + w[3] * trapezoid_score(F.col("half_life"), *cfg["hl"])
    return F.when(F.coalesce(F.col("adf_stat") < cfg["gate"], F.lit(False)), 100.0 * total).otherwise(0.0)
