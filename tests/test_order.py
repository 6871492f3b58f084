"""Results that do not hang on the order of files, and ties that every run breaks alike."""

import math

from pyspark.sql import functions as F

from gapline.operators import calibrate, segments
from gapline.streaming import events as stream


def test_rises_of_files_that_stand_out_of_order(spark, tmp_path):
    rows = [("a", us, float(us % 7)) for us in range(1, 61)]
    mixed = spark.createDataFrame(rows[1::2], "series string, us long, x double").coalesce(1).union(spark.createDataFrame(rows[::2], "series string, us long, x double").coalesce(1))
    for ordered in (1000, 25):
        path = f"{tmp_path}/{ordered}"
        seen = stream.closed(spark, mixed, f"{path}/arrivals", ordered=ordered).withColumn("ts", F.timestamp_micros("us"))
        got = stream.drained(stream.rises(seen), path).where("series IS NOT NULL").collect()
        assert sorted(r.start for r in got) == [1, *range(7, 58, 7)]


def test_first_seen_breaks_ties_by_all_columns(spark):
    rows = [(i % 20, 1, (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, day long, value long")
    want = {k: min(v for x, _, v in rows if x == k) for k in range(20)}
    for n in (1, 5):
        got = segments.first_seen(df.repartition(n, "value").orderBy(F.desc("value")), "key", [F.col("day")])
        assert {r.key: r.value for r in got.collect()} == want


def test_peaks_whose_nearest_is_not_positive_are_left_out(spark):
    events = spark.createDataFrame([("a", 100 * i, 10.0) for i in range(6)], "series string, t long, value double")
    truth = spark.createDataFrame([("a", 100 * i + 1, 0.0 if i == 2 else 100.0) for i in range(6)], "series string, t long, value double")
    got = calibrate.peak_correction(events, truth, 1000, 150, 0.2, 1).collect()
    assert [(round(r.x, 9), round(r.y, 9), r.n) for r in got] == [(1.0, math.log10(100), 5)]
