"""Causal, centred and look-ahead features on dense grids (k whole numbers, missing values null).

All frames are ranges of k, dealt by time chunk with halo rows (frames.framed), those over samples as dense as they come by tables
of spans (spans.measured); an even width is centred as width/2 before
and width/2 - 1 after.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames, spans


def trailing_percentile(df: DataFrame, width: int, q: float, name: str = "percentile", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Percentile of the last `width` steps, nulls left out, interpolated linearly; before the series' first step stand
    width - 1 copies of its first value (nulls, if it is null)."""
    first = df.groupBy(by).agg(F.min_by(F.struct(x), k).alias("_x"), F.min(k).alias("_k"))
    pad = first.select(by, F.explode(F.sequence(F.col("_k") - (width - 1), F.col("_k") - 1)).alias(k), F.col(f"_x.{x}").alias(x)) if width > 1 else None
    rows = df.withColumn("_own", F.lit(True))
    rows = rows.unionByName(pad.withColumn("_own", F.lit(False)), True) if pad is not None else rows
    out = frames.framed(rows, k, width - 1, 0, lambda w: {name: F.percentile(x, F.lit(q)).over(w.rangeBetween(1 - width, 0))}, by)
    return out.where("_own").drop("_own")


def trailing_range_percentile(df: DataFrame, before: int, skip: int, q: float, least: int, name: str = "percentile", x: str = "x", t: str = "t", by: str = "series") -> DataFrame:
    """Percentile over (t - before, t - skip] in whole seconds; null with fewer than `least` values."""

    def measure(ts, xs, at):
        a, z = spans.bounds(ts, at - (before - 1), at - skip)
        return {name: spans.Ranks(xs).quantile(a, z, q, least)}

    return spans.measured(df, measure, f"{name} double", before, x=x, t=t, by=by)


def centred_percentile(df: DataFrame, width: int, q: float, name: str = "percentile", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Percentile over width // 2 steps to both sides, edges reflected without repeating the edge. Looks ahead: for labels only."""
    h = width // 2
    ends = df.groupBy(by).agg(F.min(k).alias("_a"), F.max(k).alias("_z"))
    both = df.join(ends, by)
    left = both.where((F.col(k) > F.col("_a")) & (F.col(k) <= F.col("_a") + h)).withColumn(k, 2 * F.col("_a") - F.col(k))
    right = both.where((F.col(k) < F.col("_z")) & (F.col(k) >= F.col("_z") - h)).withColumn(k, 2 * F.col("_z") - F.col(k))
    rows = both.withColumn("_own", F.lit(True)).union(left.withColumn("_own", F.lit(False))).union(right.withColumn("_own", F.lit(False)))
    out = frames.framed(rows, k, h, h, lambda w: {name: F.percentile(x, F.lit(q)).over(w.rangeBetween(-h, h))}, by)
    return out.where("_own").drop("_own", "_a", "_z")


def causal_mean(df: DataFrame, width: int, name: str = "mean", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Mean of the values among the last `width` steps; null where there are none."""
    return frames.framed(df, k, width - 1, 0, lambda w: {name: F.avg(x).over(w.rangeBetween(1 - width, 0))}, by)


def causal_diff(df: DataFrame, lag: int, fill_first: bool = True, name: str = "diff", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """x at k less x at k - lag, 0 in the first `lag` steps. Nulls count as 0 before differencing, or (`fill_first` False) after."""
    v = F.coalesce(F.col(x), F.lit(0.0)) if fill_first else F.col(x)
    rows = df.withColumn("_v", v)
    out = frames.framed(rows, k, lag, 0, lambda w: {"_l": F.first("_v").over(w.rangeBetween(-lag, -lag)), "_h": F.count(F.lit(1)).over(w.rangeBetween(-lag, -lag))}, by)
    return out.withColumn(name, F.when(F.col("_h") == 0, 0.0).otherwise(F.coalesce(F.col("_v") - F.col("_l"), F.lit(0.0)))).drop("_v", "_l", "_h")


def centred_mean(df: DataFrame, width: int, name: str = "mean", least: float = 0.0, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Mean around each step, nulls left out; null where less than the share `least` of the width has values."""
    a, b = width // 2, (width - 1) // 2

    def columns(w):
        f = w.rangeBetween(-a, b)
        return {name: F.when(F.count(x).over(f) >= least * width, F.avg(x).over(f))}

    return frames.framed(df, k, a, b, columns, by)


def derivative(df: DataFrame, dt: float, smooth: int, name: str = "slope", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Central difference of the centred mean, one-sided at the ends of the series, a second."""
    s = centred_mean(df, smooth, "_s", x=x, k=k, by=by)

    def columns(w):
        return {"_p": F.first(F.struct("_s")).over(w.rangeBetween(-1, -1)), "_n": F.first(F.struct("_s")).over(w.rangeBetween(1, 1))}

    out = frames.framed(s, k, 1, 1, columns, by)
    up = F.when(F.col("_n").isNull(), F.col("_s")).otherwise(F.col("_n._s"))
    down = F.when(F.col("_p").isNull(), F.col("_s")).otherwise(F.col("_p._s"))
    steps = F.col("_n").isNotNull().cast("int") + F.col("_p").isNotNull().cast("int")
    return out.withColumn(name, F.when(steps > 0, (up - down) / (steps * dt))).drop("_s", "_p", "_n")


def background_noise(df: DataFrame, dt: int, before: int = 1800, guard: int = 120, least: int = 10, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """background: median over (t - before, t - guard]; noise: 1.4826/sqrt(2) times the median absolute step over the same
    frame. Null with fewer than `least` values, or where no step stands exactly `guard` earlier."""
    a, g = before // dt - 1, guard // dt

    def steps(w):
        return {"_d": F.abs(F.col(x) - F.first(x).over(w.rangeBetween(-1, -1)))}

    def columns(w):
        f = w.rangeBetween(-a, -g)
        there = F.count(F.lit(1)).over(w.rangeBetween(-g, -g)) > 0
        return {
            "background": F.when(there & (F.count(x).over(f) >= least), F.percentile(x, F.lit(0.5)).over(f)),
            "noise": F.when(there & (F.count("_d").over(f) >= least), F.percentile("_d", F.lit(0.5)).over(f) * (1.4826 / 2**0.5)),
        }

    return frames.framed(frames.framed(df, k, 1, 0, steps, by), k, a, 0, columns, by).drop("_d")


def rolling(df: DataFrame, span: int, step: int, how: str, name: str, least: float = 0.3, x: str = "x", t: str = "t", by: str = "series") -> DataFrame:
    """min, max, mean or median over (t - span, t], null where less than the share `least` of span / step has values."""
    def measure(ts, xs, at):
        a, z = spans.bounds(ts, at - (span - 1), at)
        n = z - a
        if how in ("min", "max"):
            out = spans.extremes(xs, a, z, {"min": np.fmin, "max": np.maximum}[how])
        else:
            out = spans.Ranks(xs).quantile(a, z, 0.5) if how == "median" else np.ma.masked_array(spans.sums(xs, a, z) / np.maximum(n, 1), n == 0)
        return {name: np.ma.masked_array(out, np.ma.getmaskarray(out) | (n < least * span / step))}

    return spans.measured(df, measure, f"{name} double", span, x=x, t=t, by=by)


def occurrence(df: DataFrame, horizon: int, on: Column, name: str = "occurs", k: str = "k", by: str = "series") -> DataFrame:
    """Whether `on` holds at any step of [k, k + horizon]: 1 or 0, nothing beyond the end."""
    rows = df.withColumn("_on", F.coalesce(on, F.lit(False)).cast("int"))
    return frames.framed(rows, k, 0, horizon, lambda w: {name: F.max("_on").over(w.rangeBetween(0, horizon))}, by).drop("_on")


def leads(df: DataFrame, horizons: list[int], x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """lead_<h>: the value h steps on, null where there is none."""
    return frames.framed(df, k, 0, max(horizons), lambda w: {f"lead_{h}": F.first(x).over(w.rangeBetween(h, h)) for h in horizons}, by)


def lookahead_max(df: DataFrame, steps: int, least: int, name: str = "ahead", x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Greatest value of [k, k + steps - 1], null with fewer than `least` values."""

    def columns(w):
        f = w.rangeBetween(0, steps - 1)
        return {name: F.when(F.count(x).over(f) >= least, F.max(x).over(f))}

    return frames.framed(df, k, 0, steps, columns, by)


def next_on(df: DataFrame, on: Column, name: str = "next_on", k: str = "k", by: str = "series", chunk: int = 4096) -> DataFrame:
    """The first step at or after each one where `on` holds, or null."""
    return frames.carried(df, [F.col(k)], F.when(on, F.col(k)), name, F.floor(F.col(k) / chunk), by, last=False)


def streak(df: DataFrame, on: Column, name: str = "streak", k: str = "k", by: str = "series", chunk: int = 4096) -> DataFrame:
    """Steps since `on` last failed (0 where it fails); the series' start counts as a failure."""
    w = frames.carried(df, [F.col(k)], F.when(~F.coalesce(on, F.lit(False)), F.col(k)), "_off", F.floor(F.col(k) / chunk), by)
    first = df.groupBy(by).agg((F.min(k) - 1).alias("_a"))
    return w.join(first, by).withColumn(name, F.col(k) - F.coalesce("_off", "_a")).drop("_off", "_a")


def tied_ranks(df: DataFrame, x: str, name: str = "rank", by: str = "series", chunks: int = 1024) -> DataFrame:
    """Ranks from 1, ties sharing the mean of theirs. Counts by value are ranked, not rows, in `chunks` ranges of the values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy(by).agg(F.min(x).cast("double").alias("_a"), F.max(x).cast("double").alias("_z"))
    part = F.when(F.col("_z") > F.col("_a"), F.floor((F.col(x) - F.col("_a")) / (F.col("_z") - F.col("_a")) * chunks)).otherwise(F.lit(0))
    upto = frames.running(counts.join(ends, by), [F.col(x)], F.col("_n"), "_upto", part, by)
    return df.join(upto.select(by, x, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name)), [by, x])


def envelope(df: DataFrame, y: str, order: str, name: str = "envelope", by: str = "series", chunk: int = 4096) -> DataFrame:
    """Running maximum along a numeric order."""
    return frames.running(df, [F.col(order)], F.col(y), name, F.floor(F.col(order) / chunk), by, "max")


def smoothed_score(history: DataFrame, k: int, x: str = "score", order: str = "epoch", by: str = "run", name: str = "smoothed") -> DataFrame:
    """Mean of each epoch's score and the k - 1 before it, fewer at the start. A run has few epochs."""
    return history.withColumn(name, F.avg(x).over(W.partitionBy(by).orderBy(order).rowsBetween(-(max(k, 1) - 1), 0)))
