"""Fitted maps: piecewise-linear calibration, log-log anchors, isotonic probabilities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames, walks
from .quantiles import quantiles


def piecewise_fit(df: DataFrame, x: str, y: str, width: float, least: int) -> DataFrame:
    """Knots (x, y): medians in bins of x aligned to multiples of `width` with `least` rows or more; y never falls."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    bins = quantiles(rows.withColumn("b", F.floor(F.col(x) / width)), ["b"], {"kx": (F.col(x), 0.5), "ky": (F.col(y), 0.5)}, [F.count(F.lit(1)).alias("n")])
    fine = bins.where(F.col("n") >= least)
    return fine.select(F.col("kx").alias("x"), F.max("ky").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("y"), "n")  # one row a bin


def piecewise_apply(df: DataFrame, knots: DataFrame, x: str, name: str = "calibrated", flat: bool = False) -> DataFrame:
    """`df` with the piecewise-linear map through `knots` (x, y), end slopes going on; null for a null x or fewer than 2 knots.
    `flat`: level beyond the end knots instead.

    A knot carries its segment's line; each row takes that of the last knot at or before it by an as-of join, so any number of
    knots will do. Of knots with equal x the last line counts.
    """
    w = W.orderBy("x", "y")  # one row a bin
    line = knots.select("x", "y", F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1"), F.row_number().over(w).alias("_n"))
    slope = F.when(F.col("_x1") > F.col("x"), (F.col("_y1") - F.col("y")) / (F.col("_x1") - F.col("x"))).otherwise(0.0)
    seg = lambda t, s: (F.lit(0).alias("_by"), t.alias("_t"), F.struct("_n", F.col("x").alias("x0"), F.col("y").alias("y0"), s.alias("s")).alias("_seg"))
    low = F.lit(float("-inf"))
    if flat:
        segs = line.select(*seg(F.col("x"), slope)).union(line.where("_n = 1").select(*seg(low, F.lit(0.0))))
    else:
        segs = line.where(F.col("_x1").isNotNull()).select(*seg(F.when(F.col("_n") == 1, low).otherwise(F.col("x")), slope))
    segs = segs.groupBy("_by", "_t").agg(F.max("_seg").alias("_seg"))
    rows = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select("_row", F.lit(0).alias("_by"), F.col(x).cast("double").alias("_t"))
    # the order of magnitude deals out rows and knots; a chunk has a part of them
    chunk = F.coalesce(F.floor(F.signum("_t") * F.log1p(F.abs("_t")) * 64).cast("long"), F.lit(-(2**62)))
    both = rows.select("_by", "_t", F.lit(1).alias("_side"), F.lit(None).cast(segs.schema["_seg"].dataType).alias("_seg"), "_row").unionByName(segs.select("_by", "_t", F.lit(0).alias("_side"), "_seg", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    chunk = F.when(F.col("_t") == float("-inf"), F.lit(-(2**61))).otherwise(chunk)
    got = frames.carried(both, [F.col("_t"), F.col("_side")], F.col("_seg"), "_got", chunk, "_by").where("_side = 1")
    return got.select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_got.y0") + (F.col("_t") - F.col("_got.x0")) * F.col("_got.s")).alias(name))


def peak_correction(events: DataFrame, truth: DataFrame, width: int, most: int = 300, bins: float = 0.2, least: int = 20, train: Column | None = None, by: str = "series") -> DataFrame:
    """Knots that map log10 of an event's peak value to that of the peak of `truth` nearest in time (at most `most` seconds away),
    fitted on the events where `train` holds. Both have t and value; where the nearest has no positive value, the event is left out."""
    from .temporal import nearest

    rows = events if train is None else events.where(train)
    pairs = nearest(rows.where("value > 0"), truth.select(by, "t", F.col("value").alias("v")), ["v"], width, by=by, most=most)
    logs = pairs.where(F.col("nearest_v") > 0).select(F.log10("value").alias("x"), F.log10("nearest_v").alias("y"))
    return piecewise_fit(logs, "x", "y", bins, least)


def line(df: DataFrame, x: str, y: str, by: str = "series") -> DataFrame:
    """Straight line through all rows of each series: n, slope and intercept of y on x."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def anchor(df: DataFrame, x: str, y: str, least: int = 1000) -> DataFrame:
    """Least squares of log10 y on log10 x over positive rows: slope, intercept, scatter, n; null below `least` rows."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    fit = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.var_pop("ly").alias("v"), F.corr("ly", "lx").alias("r"))
    ok = F.col("n") >= least
    scatter = F.sqrt(F.greatest(F.col("v") * (1 - F.col("r") * F.col("r")), F.lit(0.0)))
    return fit.select("n", *[F.when(ok, c).alias(a) for a, c in (("slope", F.col("slope")), ("intercept", F.col("intercept")), ("scatter", scatter))])


def _minorant(t: pd.DataFrame) -> pd.DataFrame:
    """Corners of the greatest convex minorant of points (cw, cs) in the order of cw."""
    t = t.sort_values("cw")
    kept: list[int] = []
    w, s = t["cw"].to_numpy(), t["cs"].to_numpy()
    for i in range(len(t)):
        while len(kept) > 1 and (s[kept[-1]] - s[kept[-2]]) * (w[i] - w[kept[-1]]) >= (s[i] - s[kept[-1]]) * (w[kept[-1]] - w[kept[-2]]):
            kept.pop()
        kept.append(i)
    return t.iloc[kept][["cw", "cs", "x"]]


def isotonic(df: DataFrame, p: str, y: str, least: int = 50, width: int = 1 << 14) -> DataFrame:
    """Knots (x, y) of the isotonic fit of outcomes on scores, values to 6 places; the identity below `least` rows or with one class.

    The fit is the slopes of the greatest convex minorant of the running sums. A minorant of a range has the corners that count
    for any range around it, so those of ranges of `width` rows are merged 64 at a time, until one is left; it has no more than
    about n^(2/3) corners for n rows. No other step has a range of unbounded size.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.lit(0).alias("series"), F.col(p).cast("double").alias("x"), F.col(y).cast("double").alias("v"))
    pooled = rows.groupBy("series", "x").agg(F.sum("v").alias("s"), F.count(F.lit(1)).cast("double").alias("w"), F.min("v").alias("a"), F.max("v").alias("z"))
    n, low, high = pooled.agg(F.sum("w"), F.min("a"), F.max("z")).first()
    if (n or 0) < least or low == high:
        return df.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    chunk = F.floor(F.col("x") * 65_536)
    sums = frames.running(frames.running(pooled, [F.col("x")], F.col("s"), "cs", chunk), [F.col("x")], F.col("w"), "cw", chunk)
    points = walks.written(sums.select("x", "w", F.col("cs").cast("double").alias("cs"), F.col("cw").cast("double").alias("cw")), "points")
    hull = points.select("cw", "cs", "x").union(df.sparkSession.createDataFrame([(0.0, 0.0, None)], "cw double, cs double, x double"))
    while True:
        hull = hull.groupBy(F.floor(F.col("cw") / width).alias("part")).applyInPandas(lambda key, t: _minorant(t), "cw double, cs double, x double")
        if width > n:
            break
        width *= 64
    ahead = W.orderBy("cw")  # corners alone
    edges = hull.select("cw", "cs", F.lead("cw").over(ahead).alias("cw1"), F.lead("cs").over(ahead).alias("cs1"), F.lead("x").over(ahead).alias("x1")).where("cw1 IS NOT NULL")
    level = edges.select("cw", "x1", F.round((F.col("cs1") - F.col("cs")) / (F.col("cw1") - F.col("cw")), 6).alias("y"))
    first = points.select((F.col("cw") - F.col("w")).alias("cw"), F.col("x").alias("x0"))
    return level.join(first, "cw").select(F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), "y")


def probability(df: DataFrame, knots: DataFrame, p: str, name: str = "calibrated") -> DataFrame:
    """`df` with the calibrated probability, linear between knots, flat beyond the end ones and within [0, 1]."""
    out = piecewise_apply(df, knots, p, name, flat=True)
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0))))
