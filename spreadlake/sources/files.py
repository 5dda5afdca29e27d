"""Sources and sinks: vendor files, caches, contract tables, results."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rolling import finite

#: The vendor's column names and ours.
VENDOR = {"Open": "open", "High": "high", "Low": "low", "Last": "close", "Volume": "volume", "NumberOfTrades": "num_trades", "BidVolume": "bid_vol", "AskVolume": "ask_vol"}


def _number(name: str) -> Column:
    """A column of text as numbers; what is no finite number (so NaN, too) is NULL."""
    return finite(F.expr(f"try_cast(trim(`{name}`) as double)"))


def _time(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.trim(date), F.trim(time)), F.lit("y/M/d H:m:s")).cast("timestamp_ntz")


def vendor_csv(spark: SparkSession, path: str, instrument: str | None = None) -> DataFrame:
    """instrument, ts and the vendor's columns that a file has; bad numbers are NULL, duplicates stay.

    Without an instrument its name is the file's, up to the first `_`, `-` or `.`; so a glob reads all legs at once.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    name = F.lit(instrument) if instrument else F.regexp_extract(F.col("_metadata.file_name"), "^([^_.-]+)", 1)
    have = [c for c in VENDOR if c in raw.columns]
    return raw.select(name.alias("instrument"), _time(F.col("Date"), F.col("Time")).alias("ts"), *(_number(c).alias(VENDOR[c]) for c in have)).filter("ts is not null")


def ticks_for_days(spark: SparkSession, path: str, trades: DataFrame, instrument: str | None = None) -> DataFrame:
    """Ticks of the days on which a trade is open.  The days are compared as text before any time is parsed."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    days = trades.select(F.explode(F.sequence(F.to_date("entry_time"), F.to_date("exit_time"))).alias("_day")).distinct()
    day = F.to_date(F.try_to_timestamp(F.trim("Date"), F.lit("y/M/d")))
    kept = raw.withColumn("_day", day).join(days, "_day", "left_semi")
    name = F.lit(instrument) if instrument else F.lit(None).cast("string")
    return kept.select(name.alias("instrument"), _time(F.col("Date"), F.col("Time")).alias("ts"), _number("Last").alias("last"))


def indicator_tsv(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """ts and the columns of an indicator export: tabs, two header lines, newest first.

    wanted: our name -> a part of the export's column name, compared without regard to case; a column
    that no name matches is NULL.  The headers are read on the driver (two lines).
    """
    head = [line.split("\t") for line in spark.read.text(path, wholetext=False).limit(2).toPandas()["value"]]
    names = [" ".join(parts).strip().lower() for parts in zip(*head, strict=False)]
    raw = spark.read.text(path).withColumn("_c", F.split("value", "\t"))
    at = {k: next((i for i, n in enumerate(names) if part.lower() in n), None) for k, part in wanted.items()}
    stamp = F.regexp_replace(F.trim(F.col("_c")[0]), " +", " ")
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("y-M-d H:m:s")), F.try_to_timestamp(stamp, F.lit("y/M/d H:m:s"))).cast("timestamp_ntz")
    cols = [F.expr(f"try_cast(trim(get(_c, {i})) as double)").alias(k) if i is not None else F.lit(None).cast("double").alias(k) for k, i in at.items()]
    return raw.select(ts.alias("ts"), *cols).filter("ts is not null")


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def write_cache(df: DataFrame, folder: str, config: dict, by: list[str]) -> str:
    """Writes df under the hash of the configuration that made it, so another configuration never reads it."""
    path = f"{folder}/{config_hash(config)}"
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def read_cache(spark: SparkSession, folder: str, config: dict) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/{config_hash(config)}")
    except AnalysisException:
        return None


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """name and figures of each contract of a YAML or JSON file, as a small table."""
    text = Path(path).read_text()
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    data = data.get("instruments", data)
    fields = ["multiplier", "tick_size", "tick_value", "commission", "margin"]
    rows = [(k, v.get("exchange"), *(float(v[f]) if v.get(f) is not None else None for f in fields)) for k, v in data.items()]
    return spark.createDataFrame(rows, "name string, exchange string, " + ", ".join(f"{f} double" for f in fields))


def contract(table: DataFrame, name: str) -> dict:
    rows = table.filter(F.col("name") == name).collect()
    if not rows:
        raise KeyError(f"unknown instrument {name}")
    return rows[0].asDict()


def read_grid(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_grid(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_outputs(folder: str, trades: DataFrame, equity: DataFrame, summary: DataFrame) -> None:
    """Trades and equity as CSV, the summary as JSON."""
    trades.write.mode("overwrite").option("header", True).csv(f"{folder}/trades")
    equity.write.mode("overwrite").option("header", True).csv(f"{folder}/equity")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_report(folder: str, parts: dict[str, DataFrame], limit: int = 200) -> str:
    """An HTML report of small tables (a top-`limit` of each)."""
    body = "".join(f"<h2>{name}</h2>{df.limit(limit).toPandas().to_html(index=False)}" for name, df in parts.items())
    path = Path(folder) / "report.html"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>{body}</body></html>")
    return str(path)
