"""Quantiles by refined histograms against Spark's exact percentile."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import quantiles

QS = (0.0, 0.25, 0.5, 0.9, 1.0)


def rows():
    rng = random.Random(12)
    out = [("a", i % 3, rng.gauss(0, 1), float(rng.randrange(4))) for i in range(900)]
    out += [("b", 0, math.exp(rng.gauss(0, 30)) * rng.choice([-1, 1]), None) for _ in range(700)]  # far apart
    out += [("c", 0, 1.5, 1e-320 * rng.randrange(9)) for _ in range(500)]  # one value; the least numbers
    out += [("d", 1, rng.choice([1.7e308, -1.7e308, float("inf"), float("-inf"), 0.0, -0.0]), 1.0 + rng.randrange(3) * 2**-52) for _ in range(400)]
    return [*out, ("e", 0, None, None), ("f", 0, 2.0, None), (None, None, 3.0, 4.0)]


@pytest.mark.parametrize("small,buckets", [(10**6, 4096), (0, 4096), (450, 7)])
def test_against_percentile(spark, small, buckets):
    df = spark.createDataFrame(rows(), "k string, j int, x double, y double")
    asked = {f"{c}{i}": (F.col(c), q) for c in "xy" for i, q in enumerate(QS)}
    got = quantiles.quantiles(df, ["k", "j"], asked, [F.count("x").alias("n")], small, buckets).collect()
    want = df.groupBy("k", "j").agg(F.count("x").alias("n"), *[F.percentile(c, F.lit(q)).alias(f"{c}{i}") for c in "xy" for i, q in enumerate(QS)]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 9


def test_without_groups(spark):
    df = spark.createDataFrame(rows(), "k string, j int, x double, y double")
    for small in (10**6, 0):
        r = quantiles.quantiles(df, [], {"m": (F.col("y"), 0.5), "n": (F.col("y") + 1, 0.5)}, small=small).collect()
        assert len(r) == 1 and r[0].n == r[0].m + 1 == df.agg(F.percentile("y", F.lit(0.5))).first()[0] + 1
        assert quantiles.quantiles(df.limit(0), [], {"m": (F.col("y"), 0.5)}, small=small).collect()[0].m is None
