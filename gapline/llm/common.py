"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gapline-shared"


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> None:
    """Arrow batches of this session get at most so many rows and about so many bytes; smaller settings stay.

    What a Python worker holds then does not depend on the lengths of texts, but for a single longer one.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key) or ""
        now = int(now.rstrip("b")) if now.rstrip("b").lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage in a way that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gapline-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """128 bits that depend on the values alone, so that a recomputed partition gives the same keys. Nulls count."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols]
    lengths = [F.length(p).cast("string") for p in parts]
    return F.unhex(F.md5(F.concat_ws(":", *lengths, *parts).cast("binary")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
