"""Streams over the event files, drained to their end and equal to the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gapline.functions import clocks
from gapline.streaming import events as stream

from .base import DIGITS, E_SQL, rounded
from .registry import query


def _folder(spark) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir, path, ordered=None):
    """The events as a stream of arriving files (by time, about `ordered` rows each), at the end of which a marker closes all windows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), clocks.micros(F.col("ts")).alias("us"), F.col("value").alias("x"))
    return stream.closed(spark, e, f"{path}/arrivals", ordered=ordered).withColumn("ts", F.timestamp_micros("us"))


@query(f"WITH {E_SQL} SELECT series, t // 600 * 600 AS start, round(avg(x), {DIGITS}) + 0.0 AS mean, count(x) AS n FROM e GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    path = _folder(spark)
    out = stream.drained(stream.tumbling(_events(spark, sf_dir, path), late="40 days"), path)
    return rounded(out.where("series IS NOT NULL").select("series", F.unix_seconds("start").alias("start"), "mean", "n"))


@query(f"WITH {E_SQL}, w AS (SELECT series, t // 600 * 600 - 600 * unnest(range(0, 6)) AS start, x FROM e) SELECT series, start, max(x) AS top, count(x) AS n FROM w GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    path = _folder(spark)
    out = stream.drained(stream.sliding(_events(spark, sf_dir, path), late="40 days"), path)
    return out.where("series IS NOT NULL").select("series", F.unix_seconds("start").alias("start"), "top", "n")


@query(f"""WITH {E_SQL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY series ORDER BY us) AS g FROM e), r AS (SELECT *, sum((g IS NULL OR g > 360000000)::INT) OVER (PARTITION BY series ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT series, min(us) AS start, max(us) + 360000000 AS stop, count(x) AS n, max(x) AS top FROM r GROUP BY series, run""")
def stream_session(spark, sf_dir):
    path = _folder(spark)
    out = stream.drained(stream.sessions(_events(spark, sf_dir, path), late="40 days"), path)
    return out.where("series IS NOT NULL").select("series", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n", "top")


@query(f"""WITH {E_SQL}, u AS (SELECT series, us, min(x) AS x FROM e GROUP BY ALL), d AS (SELECT *, coalesce(x > lag(x) OVER (PARTITION BY series ORDER BY us), false) AS up FROM u),
r AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY series ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY us) AS i, first_value(us) OVER (PARTITION BY series, run ORDER BY us) AS start, first_value(x) OVER (PARTITION BY series, run ORDER BY us) AS low FROM r)
SELECT series, start, us AS stop, low, x AS high FROM n WHERE i = 3""")
def stream_rise_state(spark, sf_dir):
    path = _folder(spark)
    return stream.drained(stream.rises(_events(spark, sf_dir, path, 1_000_000)), path).where("series IS NOT NULL")


@query(f"WITH {E_SQL} SELECT series, t // 3600 AS hour, round(avg(x), {DIGITS}) + 0.0 AS mean FROM e GROUP BY ALL")
def append_only_forecast(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), F.floor(clocks.micros(F.col("ts")) / 3_600_000_000).alias("hour"), F.col("value").alias("x"))
    rows = e.groupBy("series", "hour").agg(F.avg("x").alias("mean"))
    path = _folder(spark)
    stream.forecasts(spark, rows.where("hour % 2 = 0"), path, ["series", "hour"])
    stream.forecasts(spark, rows.withColumn("mean", F.when(F.col("hour") % 2 == 1, F.col("mean")).otherwise(-1.0)), path, ["series", "hour"])
    return rounded(spark.read.parquet(path))
