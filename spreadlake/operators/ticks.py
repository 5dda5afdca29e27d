"""Ticks inside trades, overlaps of trade lists, and the two-speed back-test."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def excursions(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Best and worst PnL of each trade, when, and how many ticks it saw."""
    return curve.groupBy(*keys).agg(F.max("pnl").alias("mfe"), F.min("pnl").alias("mae"), F.max_by("ts", "pnl").alias("mfe_ts"), F.min_by("ts", "pnl").alias("mae_ts"), F.count("*").alias("ticks"))


def first_touch(curve: DataFrame, keys: list[str], target: float, stop: float, order: list[str]) -> DataFrame:
    """Which of a take-profit and a stop-loss each PnL curve touches first, and the PnL there (at the end, if none)."""
    at = F.struct(*(F.col(c) for c in order), "pnl")
    got = curve.groupBy(*keys).agg(F.min(F.when(F.col("pnl") >= target, at)).alias("_tp"), F.min(F.when(F.col("pnl") <= -stop, at)).alias("_sl"), F.max(at).alias("_end"))
    tp = F.col("_tp").isNotNull() & (F.col("_sl").isNull() | (F.col("_tp") < F.col("_sl")))
    touch = F.when(tp, "TP").when(F.col("_sl").isNotNull(), "SL").otherwise("NONE")
    return got.select(*keys, touch.alias("touch"), F.when(tp, F.col("_tp.pnl")).when(F.col("_sl").isNotNull(), F.col("_sl.pnl")).otherwise(F.col("_end.pnl")).alias("pnl"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of trades (columns of b behind o_) that are open at once; buckets of bars make it an equi-join."""
    cut = lambda d, lo, hi: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor(F.col(hi) / BUCKET))))
    other = b.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("entry_bar", "exit_bar", "side", "pnl_net")))
    met = cut(a, "entry_bar", "exit_bar").join(cut(other, "o_entry_bar", "o_exit_bar"), [*keys, "_b"])
    return met.filter((F.col("entry_bar") < F.col("o_exit_bar")) & (F.col("o_entry_bar") < F.col("exit_bar"))).drop("_b").dropDuplicates([*keys, "entry_bar", "o_entry_bar"])


def trade_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many of a's trades overlap one of b's, how many of these have the side of their first match, and their PnL."""
    first = overlapping(a, b, keys).groupBy(*keys, "entry_bar").agg(F.first("side").alias("side"), F.first("pnl_net").alias("pnl"), F.min_by("o_side", "o_entry_bar").alias("o_side"))
    found = first.groupBy(*keys).agg(F.count("*").alias("overlapping"), F.count_if(F.col("side") == F.col("o_side")).alias("same_side"), F.sum("pnl").alias("pnl"))
    return a.groupBy(*keys).agg(F.count("*").alias("n1")).join(found, keys, "left")


def set_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sizes of two sets of values, of their intersection, and its share of the smaller."""
    x, y = a.select(column).distinct().withColumn("_x", F.lit(1)), b.select(column).distinct().withColumn("_y", F.lit(1))
    out = x.join(y, column, "full").agg(F.count("_x").alias("n1"), F.count("_y").alias("n2"), F.count(F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), 1)).alias("both_days"))
    return out.withColumn("share", F.col("both_days") / F.nullif(F.least("n1", "n2"), F.lit(0)))


def nearest(a: DataFrame, b: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """Each of a's rows with the nearest value of b within `most`, the smaller of two as near."""
    near = b.select(*keys, F.col(column).alias("other")).withColumn("_at", F.explode(F.sequence(F.col("other") - most, F.col("other") + most)))
    met = a.withColumn("_at", F.col(column)).join(near, [*keys, "_at"])
    w = Window.partitionBy(*keys, column).orderBy(F.abs(F.col(column) - F.col("other")), "other")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_at")


def greedy_match(a: DataFrame, b: DataFrame, keys: list[str], most: int, column: str = "entry_bar") -> DataFrame:
    """One-to-one matches (column, other): a's entries in order, each with its nearest entry of b within `most` that is still free, the earlier of two as near.

    Both lists stream in one order; what waits is what lies within 2 * `most` of the newest entry.
    """
    from .walk import in_order

    both = a.select(*keys, F.col(column).cast("bigint").alias("_at"), F.lit(0).alias("_list")).unionByName(b.select(*keys, F.col(column).cast("bigint").alias("_at"), F.lit(1).alias("_list")))
    # each of a's entries is decided `most` behind itself, when all its partners are known; b's come first at one place
    both = both.withColumn("_turn", F.col("_at") + F.when(F.col("_list") == 0, most).otherwise(0))
    names = [*keys, column, "other"]

    def start():
        free: deque[int] = deque()

        def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found, other = [], [], []
            for i, (at, which) in enumerate(zip(batch.column("_at").to_pylist(), batch.column("_list").to_pylist(), strict=True)):
                if which:
                    free.append(at)
                    continue
                while free and free[0] < at - most:
                    free.popleft()
                near = min((x for x in free if x <= at + most), key=lambda x: (abs(x - at), x), default=None)
                if near is not None:
                    free.remove(near)
                    rows.append(i)
                    found.append(at)
                    other.append(near)
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(found, pa.int64()), pa.array(other, pa.int64())], names)

        return walk

    schema = ", ".join([*(f"`{k}` {a.schema[k].dataType.simpleString()}" for k in keys), f"`{column}` bigint", "other bigint"])
    return in_order(both.withColumn("_last", 1 - F.col("_list")), keys, ["_turn", "_last", "_at"], start, schema)


@dataclass(frozen=True)
class HybridConfig:
    """Levels of the two-speed back-test; minutes are of the day; 0 turns a dollar exit off."""

    entry: float = 2.0
    leave: float = 0.5
    stop: float = 4.0
    cooldown: float = 0.5
    dollar_target: float = 0.0
    dollar_stop: float = 0.0
    start: int = 240
    end: int = 840
    flat: int = 930
    mult_a: float = 20.0
    mult_b: float = 5.0
    tick_a: float = 0.25
    tick_b: float = 1.0
    commission: float = 2.5
    slippage: float = 1.0


TRADE_FIELDS = ("entry_time", "exit_time", "side", "n_a", "n_b", "entry_price_a", "entry_price_b", "exit_price_a", "exit_price_b", "pnl_gross", "costs", "pnl_net", "entry_z", "exit_z", "mfe", "mae", "exit_reason")


#: Names of the exit reasons.
TP_ZSCORE, SL_ZSCORE, TP_DOLLAR, SL_DOLLAR, FLAT_EOD = "TP_ZSCORE", "SL_ZSCORE", "TP_DOLLAR", "SL_DOLLAR", "FLAT_EOD"
LAST_BAR_SECONDS = 300


@dataclass
class _Position:
    side: int
    n_a: int
    n_b: int
    price_a: float
    price_b: float
    entered: object
    z: float
    mfe: float = 0.0
    mae: float = 0.0

    def worth(self, a: float, b: float, c: HybridConfig) -> float:
        return self.side * (self.n_a * (a - self.price_a) * c.mult_a - self.n_b * (b - self.price_b) * c.mult_b)


class HybridDesk:
    """The state of one series: a position or none, whether it cools down, and the slow bar that it is in.

    Rules.  A slow bar decides on the gate and z-score of the bar before; its own hedge, mean and
    deviation score its ticks.  A bar whose indicators are missing closes a position on its first tick
    (without a tick the position lapses) and ends a cooldown.  Outside the session everything is closed
    first.  Then a position looks at its dollar stop, dollar target, z stop and z target, in this order,
    and cools down behind any of them; a cooldown ends at the start of a bar, once the z-score of the bar
    before is inside its level.  No entry in a bar that closed a position.  A price that is not above 0
    has no z-score: it opens nothing, and closes by dollars or time only.
    """

    def __init__(self, cfg: HybridConfig) -> None:
        self.cfg, self.position, self.cooling, self.bar, self.closed_in = cfg, None, False, None, None

    def begin(self, bar: dict) -> None:
        if self.bar is not None and not self.bar["valid"]:
            self.position = None
        self.bar = bar
        bar["valid"] = all(map(math.isfinite, (bar["beta"], bar["alpha"], bar["mean"], bar["std"]))) and bar["std"] != 0
        if not bar["valid"]:
            self.cooling = False
        elif self.cooling and math.isfinite(bar["prev_z"]) and abs(bar["prev_z"]) < self.cfg.cooldown:
            self.cooling = False

    def _close(self, ts, a: float, b: float, z: float, why: str) -> tuple:
        p, c, self.position = self.position, self.cfg, None
        out_a, out_b = a - p.side * c.slippage * c.tick_a, b + p.side * c.slippage * c.tick_b
        gross, costs = p.worth(out_a, out_b, c), 2 * c.commission * (p.n_a + p.n_b)
        return (p.entered, ts, p.side, p.n_a, p.n_b, p.price_a, p.price_b, out_a, out_b, gross, costs, gross - costs, p.z, z, p.mfe, p.mae, why)

    def _reason(self, live: float, z: float | None) -> str | None:
        c = self.cfg
        if c.dollar_stop and live <= -c.dollar_stop:
            return SL_DOLLAR
        if c.dollar_target and live >= c.dollar_target:
            return TP_DOLLAR
        if z is None:
            return None
        toward = self.position.side * z  # below -stop it has run away, over -leave it has come back
        return SL_ZSCORE if toward < -c.stop else TP_ZSCORE if toward > -c.leave else None

    def tick(self, ts, a: float, b: float, minute: int) -> tuple | None:
        """A finished trade, if this tick ends one."""
        c, bar = self.cfg, self.bar
        if bar is None or (bar["end"] is not None and ts >= bar["end"]):
            return None
        if not bar["valid"]:
            return self._close(ts, a, b, 0.0, FLAT_EOD) if self.position else None
        z = (math.log(a) - bar["beta"] * math.log(b) - bar["alpha"] - bar["mean"]) / bar["std"] if a > 0 and b > 0 else None
        if minute >= c.flat or minute < c.start:
            self.cooling = False
            if self.position:
                self.closed_in = bar["number"]
                return self._close(ts, a, b, 0.0 if z is None else z, FLAT_EOD)
            return None
        if self.position:
            p = self.position
            live = p.worth(a, b, c)
            p.mfe, p.mae = max(p.mfe, live), min(p.mae, live)
            why = self._reason(live, z)
            if why:
                self.cooling, self.closed_in = True, bar["number"]
                return self._close(ts, a, b, 0.0 if z is None else z, why)
        elif not self.cooling and z is not None and abs(z) > c.entry and bar["gate"] and bar["number"] != self.closed_in and c.start <= minute < c.end:
            side = -1 if z > 0 else 1
            n_b = max(1, int(a * c.mult_a / (b * c.mult_b) * abs(bar["beta"]) + 0.5))
            self.position = _Position(side, 1, n_b, a + side * c.slippage * c.tick_a, b - side * c.slippage * c.tick_b, ts, z)
        return None


def hybrid(ticks: DataFrame, slow: DataFrame, keys: list[str], cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """Trades of a back-test that decides on ticks (ts, a, b) with indicators of slow bars.

    slow: ts, beta, alpha, mean and std of the spread, zscore, gate.  Bars and ticks of a key come as one
    stream in time order, a bar before its ticks; ticks before the first bar, and from LAST_BAR_SECONDS
    behind the start of the last one on, are not seen.  The walker keeps its state from batch to batch, so a key's
    length does not matter; keys (pairs, configurations) run in parallel.
    """
    from .rolling import ordered
    from .walk import in_order

    at = ordered(keys)
    lagged = {"gate": F.coalesce(F.lag("gate").over(at), F.lit(False)), "prev_z": F.lag("zscore").over(at)}
    end = F.when(F.lead("ts").over(at).isNull(), F.col("ts") + F.make_dt_interval(secs=F.lit(LAST_BAR_SECONDS)))
    marks = slow.select(*keys, "ts", F.lit(0).alias("_tick"), "beta", "alpha", "mean", "std", *(v.alias(k) for k, v in lagged.items()), F.row_number().over(at).alias("number"), end.alias("end"))
    both = marks.unionByName(ticks.select(*keys, "ts", F.lit(1).alias("_tick"), F.col("a").cast("double"), F.col("b").cast("double")), allowMissingColumns=True)
    both = both.withColumn("_minute", F.hour("ts") * 60 + F.minute("ts"))
    kinds = {"entry_time": "timestamp_ntz", "exit_time": "timestamp_ntz", "side": "int", "n_a": "int", "n_b": "int", "exit_reason": "string"}
    types = {f: {"timestamp_ntz": pa.timestamp("us"), "int": pa.int32(), "string": pa.string()}.get(kinds.get(f), pa.float64()) for f in TRADE_FIELDS}

    def start():
        desk = HybridDesk(cfg)
        number = lambda x: math.nan if x is None else x

        def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for r in batch.to_pylist():
                if r["_tick"]:
                    done = desk.tick(r["ts"], number(r["a"]), number(r["b"]), r["_minute"])
                    if done:
                        made.append(done)
                else:
                    desk.begin({k: number(r[k]) for k in ("beta", "alpha", "mean", "std", "prev_z")} | {k: r[k] for k in ("gate", "number", "end")})
            own = [batch.column(k).slice(0, 1).take(pa.array([0] * len(made), pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([t[i] for t in made], types[f]) for i, f in enumerate(TRADE_FIELDS))], [*keys, *TRADE_FIELDS])

        return walk

    schema = ", ".join([f"`{k}` {ticks.schema[k].dataType.simpleString()}" for k in keys] + [f"{f} {kinds.get(f, 'double')}" for f in TRADE_FIELDS])
    return in_order(both, keys, ["ts", "_tick"], start, schema)


def hybrid_summary(made: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of the two-speed trades with the largest drawdown of their cumulative PnL; rounded as a report."""
    w = Window.partitionBy(*keys).orderBy("exit_time", "entry_time").rowsBetween(Window.unboundedPreceding, 0)
    run = made.withColumn("_cum", F.sum("pnl_net").over(w))
    run = run.withColumn("_dd", F.col("_cum") - F.max("_cum").over(w))
    pnl = F.col("pnl_net")
    won, lost = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.coalesce(F.sum(F.when(pnl <= 0, -pnl)), F.lit(0.0))
    factor = F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, float("inf")).otherwise(0.0)
    return run.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.round(100 * F.avg((pnl > 0).cast("double")), 1).alias("win_rate"), F.round(F.sum(pnl), 2).alias("pnl"),
        F.round(factor, 2).alias("profit_factor"), F.round(F.avg(pnl), 2).alias("avg_pnl_trade"), F.round(F.min("_dd"), 2).alias("max_drawdown"),
    )
