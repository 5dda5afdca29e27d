"""Headline queries on one machine: prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
HEADLINE = [
    "ohlcv_resample", "asof_align", "rolling_ols", "rolling_ols_long", "rolling_adf", "rolling_hurst", "signals_fsm", "trades",
    "performance", "cpcv_summary", "grid_summary", "kalman", "mfe_mae", "monte_carlo_dd", "spearman",
]


GRID_BARS = 100_000


def grid_rates(spark) -> list[dict]:
    """Seconds of whole grids (trades and summaries of every configuration) over GRID_BARS bars of a made-up z-score."""
    from pyspark.sql import functions as F

    from spreadlake.plans import grid

    i = F.col("bar_idx")
    noise = F.pmod(F.xxhash64(i), F.lit(1000)) / 1000
    z = 2.2 * F.sin(i / 37.0) + 1.1 * F.sin(i / 11.3) + 1.6 * noise - 0.8
    bars = spark.range(GRID_BARS).select(F.lit("p").alias("pair"), F.col("id").alias("bar_idx")).withColumns({
        "ts": F.timestamp_seconds(1_600_000_000 + 300 * i), "close_a": 15_000 + 100 * F.sin(i / 500.0), "close_b": 33_000 + 150 * F.cos(i / 700.0), "beta": F.lit(1.2), "zscore": z,
    })
    out = []
    for entries, leaves in ((12, 10), (40, 30)):
        axes = {"entry": [1.5 + 0.05 * k for k in range(entries)], "leave": [0.02 * k for k in range(leaves)], "stop": [3.6, 3.8, 4.0], "time_stop": list(range(0, 100, 10))}
        begun = time.time()
        grid.run(bars, grid.axes(spark, **axes), ["pair"])[1].write.format("noop").mode("overwrite").save()
        configs, took = entries * leaves * 30, time.time() - begun
        out.append({"configs": configs, "bars": GRID_BARS, "sec": round(took, 2), "configs_per_sec": round(configs / took, 1)})
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from spreadlake import catalog

    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, took = catalog.queries(), {}
    spark.read.parquet(f"{where}/lineitem.parquet").count()  # starts the JVM's readers
    for name in HEADLINE:
        begun = time.time()
        queries[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
    begun = time.time()
    rates = grid_rates(spark)
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where), "grid": rates, "grid_sec": round(time.time() - begun, 3)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
