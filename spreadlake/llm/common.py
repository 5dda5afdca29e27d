"""Session, storage and plan helpers of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder; where neither is set a temporary one in local mode (tests), and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spreadlake-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files that table() wrote for df."""
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame, default: int = 1 << 30) -> int:
    """The optimizer's estimate of a frame's size, for choosing a number of partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 < size < 1 << 60 else default


def crc_mod4(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % 4


def held_out(column: Column) -> Column:
    """crc32 of the decimal id is 2 modulo 4; a null id is not held out."""
    return F.coalesce(crc_mod4(column) == 2, F.lit(False))


FILTER_BITS = 26


def maybe_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not among ids, by a bitmap of fixed size (8 MB).

    It only spares texts a shuffle: what it lets through is joined exactly.  A full bitmap spares nothing.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)) + 1
    maps = ids.select(bit.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_map"))
    at = rows.withColumn("_h", bit).withColumns({"_bucket": F.bitmap_bucket_number("_h"), "_at": F.bitmap_bit_position("_h")})
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = at.join(F.broadcast(maps), "_bucket").withColumn("_byte", byte)
    return met.filter(F.expr("shiftright(_byte, cast(_at % 8 as int)) % 2 = 1")).select(*rows.columns)
