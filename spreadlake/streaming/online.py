"""Bar-by-bar evaluation on streams.

ohlcv() resamples a stream of ticks under a watermark.  online_signals() keeps the last bars of each
pair as state and emits z-score and signal of every new bar; replaying finished bars gives the rows
that the batch plan gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signals import advance

OUT = "pair string, bar_idx bigint, ts timestamp_ntz, beta double, zscore double, signal int"


def ohlcv(ticks: DataFrame, every: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (ts as TIMESTAMP, open, high, low, close, volume); ticks behind the watermark are dropped."""
    out = ticks.withWatermark("ts", late).groupBy(*keys, F.window("ts", every)).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select(*keys, F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def online_signals(bars: DataFrame, window: int, z_window: int, entry: float, leave: float, stop: float) -> DataFrame:
    """pair, bar_idx, ts, beta, zscore, signal of every bar (pair, bar_idx, ts, close_a, close_b) of a stream.

    State of a pair: the log prices of the last `window` bars, the spreads of the last z_window, and
    the machine's state; its size does not grow with the stream.
    """
    kinds = "la array<double>, lb array<double>, spreads array<double>, machine int"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        la, lb, spreads, machine = ([list(x) if isinstance(x, (list, tuple, np.ndarray)) else x for x in state.get] if state.exists else [[], [], [], 0])
        rows = []
        for bar in pd.concat(list(parts)).sort_values("bar_idx").itertuples():
            la, lb = [*la, math.log(bar.close_a)][-window:], [*lb, math.log(bar.close_b)][-window:]
            beta = z = spread = math.nan
            if len(la) == window:
                var = np.var(lb, ddof=1)
                if var > 0:
                    beta = float(np.cov(la, lb)[0, 1] / var)
                    spread = la[-1] - beta * lb[-1] - (np.mean(la) - beta * np.mean(lb))
            spreads = [*spreads, float(spread)][-z_window:]
            if len(spreads) == z_window and not any(math.isnan(s) for s in spreads):
                std = np.std(spreads, ddof=1)
                z = float((spread - np.mean(spreads)) / std) if std > 0 else math.nan
            machine = advance(machine, z, entry, leave, stop)
            rows.append((key[0], bar.bar_idx, bar.ts, None if math.isnan(beta) else beta, None if math.isnan(z) else z, (0, 1, -1, 0)[machine]))
        state.update((la, lb, spreads, machine))
        yield pd.DataFrame(rows, columns=["pair", "bar_idx", "ts", "beta", "zscore", "signal"])

    return bars.groupBy("pair").applyInPandasWithState(step, OUT, kinds, "append", GroupStateTimeout.NoTimeout)


def replay(bars: DataFrame, folder: str, name: str, files: int = 4, **options) -> DataFrame:
    """The rows that online_signals() emits when finished bars are played as a stream of `files` files in time order."""
    spark = bars.sparkSession
    part = F.ntile(files).over(Window.partitionBy("pair").orderBy("bar_idx"))
    cut = bars.select("pair", "bar_idx", "ts", "close_a", "close_b").withColumn("part", part)
    for i in range(1, files + 1):
        cut.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("pair string, bar_idx bigint, ts timestamp_ntz, close_a double, close_b double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = online_signals(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
