"""Streams of samples (series, ts, x): windows with watermarks, a stateful detector, append-only results.

Every function takes a streaming DataFrame and gives one; `drained` runs a finite stream to its end and gives the result as a
batch table, for tests and comparison with the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str | None = None, files: int = 1) -> DataFrame:
    """A stream over Parquet files as they arrive; half-written files (names from . or _) are invisible."""
    kind = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(path)


def _in_order(spark: SparkSession, rows: DataFrame, path: str, most: int) -> None:
    """Writes `rows` as files of about `most` rows, one after the other in the order of us; equal times stand in one file."""
    n = max(1, -(-rows.count() // most))
    cuts = sorted({int(c) for c in rows.stat.approxQuantile("us", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = F.coalesce(sum(((F.col("us") >= c).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    dealt = f"{path}-dealt"
    rows.withColumn("_part", part).repartition(n, "_part").write.partitionBy("_part").parquet(dealt)
    for (i,) in sorted(spark.read.parquet(dealt).select("_part").distinct().collect()):  # a source takes files by their age
        spark.read.schema(rows.schema).parquet(f"{dealt}/_part={i}").coalesce(1).write.mode("append").parquet(path)


def closed(spark: SparkSession, rows: DataFrame, path: str, days: int = 3650, ordered: int | None = None) -> DataFrame:
    """A stream of `rows` (series, us, x) written under `path`, followed by two markers (null series) far in the future.

    The files of `rows` arrive in any order; with `ordered` they arrive by time, about so many rows at once.

    The first marker moves the watermark beyond every window of the rows, and the second gives the batch that puts them out,
    so a drained stream holds all of them and nothing has to be filled in. The markers' own rows have a null series.
    """
    if ordered:
        _in_order(spark, rows, path, ordered)
    else:
        rows.write.mode("append").parquet(path)
    last = rows.agg(F.coalesce(F.max("us"), F.lit(0)).alias("us"))
    for n in (1, 2):
        mark = last.select(*[(F.col("us") + n * days * 86_400_000_000 if c == "us" else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes])
        mark.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "100000d").parquet(path)


def tumbling(samples: DataFrame, width: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """series, start, mean and n per window; rows later than `late` are dropped."""
    out = samples.withWatermark("ts", late).groupBy("series", F.window("ts", width)).agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    return out.select("series", F.col("window.start").alias("start"), "mean", "n")


def sliding(samples: DataFrame, width: str = "1 hour", step: str = "10 minutes", late: str = "1 day") -> DataFrame:
    out = samples.withWatermark("ts", late).groupBy("series", F.window("ts", width, step)).agg(F.max("x").alias("top"), F.count("x").alias("n"))
    return out.select("series", F.col("window.start").alias("start"), "top", "n")


def sessions(samples: DataFrame, gap: str = "6 minutes", late: str = "1 day") -> DataFrame:
    """series, start, stop (last sample plus gap) and n of runs of samples at most `gap` apart."""
    out = samples.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap).alias("w")).agg(F.count("x").alias("n"), F.max("x").alias("top"))
    return out.select("series", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "top")


def rises(samples: DataFrame, need: int = 3, late: str = "1 day") -> DataFrame:
    """A row for each run of `need` strictly rising samples of a series: series, start, stop, low, high, emitted when it is known.

    The state of a series is its current run: start, last time and value, and its length. Samples of a batch are taken in
    order of time; one older than the state's last is dropped, so the stream must arrive in order (`closed` with `ordered`).
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, low, last, value, n = state.get if state.exists else (None, None, None, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["us", "x"])
        for us, x in zip(rows["us"], rows["x"], strict=True):
            if last is not None and us <= last:
                continue
            if n and x > value:
                n += 1
            else:
                start, low, n = us, x, 1
            last, value = us, x
            if n == need:
                out.append((key[0], start, us, low, x))
        state.update((start, low, last, value, n))
        yield pd.DataFrame(out, columns=["series", "start", "stop", "low", "high"])

    rows = samples.where(F.col("x").isNotNull()).select("series", "us", F.col("x").cast("double").alias("x"))
    return rows.groupBy("series").applyInPandasWithState(step, "series string, start long, stop long, low double, high double", "start long, low double, last long, value double, n int", "append", GroupStateTimeout.NoTimeout)


def forecasts(spark: SparkSession, features: DataFrame, path: str, key: list[str]) -> int:
    """Appends rows whose key is not in the store yet and never rewrites one; gives the number of new rows."""
    try:
        done = spark.read.parquet(path).select(*key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = features.select(*key).limit(0)
    new = features.join(done, key, "left_anti").dropDuplicates(key)
    before = done.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def settled(origins: DataFrame, ends: DataFrame, delay: int, horizon: int) -> DataFrame:
    """`origins` (series, t) with pending: whether t + delay + horizon lies beyond what the series has (series, last)."""
    return origins.join(ends, "series", "left").withColumn("pending", ~F.coalesce(F.col("t") + delay + horizon <= F.col("last"), F.lit(False))).drop("last")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """The whole result of a finite stream under `path` (checkpoint and output), as a table."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
