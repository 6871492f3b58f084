"""Masks: intervals to leave out or keep, copied days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, temporal


def mask_intervals(df: DataFrame, intervals: DataFrame, values: list[str], width: int, t: str = "t", by: str = "series") -> DataFrame:
    """`df` with `values` null and coverage 0 inside any half-open interval [start, stop), and `masked`."""
    hit = temporal.inside(df, intervals, width, t, by, closed=False)
    keep = lambda c, other: F.when(~F.col("inside"), F.col(c)).otherwise(F.lit(other))
    out = hit.withColumns({v: keep(v, None) for v in values})
    if "coverage" in df.columns:
        out = out.withColumn("coverage", keep("coverage", 0.0))
    return out.withColumnRenamed("inside", "masked")


def good_time(df: DataFrame, intervals: DataFrame, width: int, t: str = "t", by: str = "series") -> DataFrame:
    """Rows inside any closed interval [start, stop]. No intervals: no rows are good."""
    return temporal.inside(df, intervals, width, t, by).where("inside").drop("inside")


def copied_days(df: DataFrame, step: int = 600, tolerance: float = 0.01, bridge: int = 15, least: int = 1, x: str = "x", by: str = "series") -> DataFrame:
    """Runs in which a day repeats the day before at the same time of day: series, day, first, last (steps of the day), n.

    Values match where they differ by at most `tolerance` of the greater one (1 at least). Runs bridge up to `bridge` steps.
    `df` has day (number), tod (step of the day) and the value.
    """
    before = df.select(by, (F.col("day") + 1).alias("day"), "tod", F.col(x).alias("_y"))
    close = F.abs(F.col(x) - F.col("_y")) <= tolerance * F.greatest(F.abs(x), F.abs("_y"), F.lit(1.0))
    same = df.join(before, [by, "day", "tod"]).where(close)
    keyed = same.select(F.struct(by, "day").alias("_s"), "tod")
    run = frames.runs(keyed, "tod", F.lit(True), bridge, "_s")
    out = run.groupBy("_s", "run").agg(F.min("tod").alias("first"), F.max("tod").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("last") - F.col("first") + 1 >= least).select("_s.*", "first", "last", "n")


def day_correlation(df: DataFrame, truth: DataFrame, x: str = "x", y: str = "y", by: str = "series") -> DataFrame:
    """series, day, r: Pearson correlation of log10 of positive values with the truth's on each day, and n."""
    both = df.join(truth.select("day", "tod", y), ["day", "tod"]).where((F.col(x) > 0) & (F.col(y) > 0))
    return both.groupBy(by, "day").agg(F.corr(F.log10(x), F.log10(y)).alias("r"), F.count(F.lit(1)).alias("n")).withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def fine_rows(quality: Column, longitude: Column, most: float = 70.0) -> Column:
    """Quality 0 (whole number or hexadecimal text) and |longitude| <= `most`."""
    q = F.when(F.lower(quality).startswith("0x"), F.conv(F.substring(quality, 3, 16), 16, 10)).otherwise(quality).try_cast("long")
    return F.coalesce((q == 0) & (F.abs(longitude) <= most), F.lit(False))
