"""Rolling-origin skill of forecasts: one model a fold, fitted on the blocks before it alone, and the gain of one over another.

Rows are cut into blocks in the order of time. A least-squares fit needs only sums of products, so one aggregate by block gives
what the fits of all folds need: a fold's sums are those of the blocks before it. Missing values are told by an indicator beside
each feature and stand at the mean of the fold's training rows; what is fitted never sees its own block or a later one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import ranked
from .metrics import cluster_bootstrap


def blocks(df: DataFrame, n: int, order: str, by: str = "series", chunk: int = 4096) -> DataFrame:
    """`df` with `block`, 0 to n - 1: runs of rows in `order` within `by` of equal sizes, the first ones longer by one row if need be."""
    size, more, at = F.floor(F.col("_n") / n), F.col("_n") % n, F.col("_r") - 1
    early = more * (size + 1)
    block = F.when(at < early, F.floor(at / (size + 1))).otherwise(more + F.floor((at - early) / F.greatest(size, F.lit(1))))
    return ranked(df, order, by, chunk).withColumn("block", block.cast("int")).drop("_r", "_n")


def _solved(rows: pd.DataFrame, folds: int, features: int, least: int, ridge: float) -> pd.DataFrame:
    """Coefficients (constant, features, indicators, means) of each fold from the sums of the blocks before it."""
    p = 2 * features + 1
    upper = np.triu_indices(p)
    out = []
    total, target = np.zeros((p, p)), np.zeros(p)
    sums = {int(b): (g, y) for b, g, y in zip(rows["block"], rows["gram"], rows["target"], strict=True)}
    for fold in range(folds):
        n = total[0, 0]
        if n >= least:
            means = np.array([total[0, 1 + i] / (n - total[0, 1 + features + i]) if n > total[0, 1 + features + i] else 0.0 for i in range(features)])
            move = np.eye(p)  # from (1, value or 0, missing) to (1, value or mean, missing)
            for i in range(features):
                move[1 + features + i, 1 + i] = means[i]
            gram, rhs = move.T @ total @ move, move.T @ target
            centre = gram[0] / n
            spread = np.sqrt(np.maximum(np.diag(gram) / n - centre**2, 0.0))
            used = np.flatnonzero(spread > 1e-9 * np.maximum(1.0, np.abs(centre)))  # what does not vary has no slope
            cov = (gram[np.ix_(used, used)] / n - np.outer(centre[used], centre[used])) / np.outer(spread[used], spread[used])
            slope = np.zeros(p)
            slope[used] = np.linalg.lstsq(cov + ridge * np.eye(len(used)), (rhs[used] / n - centre[used] * rhs[0] / n) / spread[used], rcond=1e-10)[0] / spread[used]
            slope[0] = rhs[0] / n - slope[1:] @ centre[1:]
            out.append((fold, n, np.concatenate([slope, means]).tolist()))
        if fold in sums:
            g = np.zeros((p, p))
            g[upper] = sums[fold][0]
            total += g + np.triu(g, 1).T
            target += np.asarray(sums[fold][1])
    return pd.DataFrame(out, columns=["block", "trained", "fit"])


def rolling_forecast(df: DataFrame, features: list[str], label: str, folds: int, least: int = 50, ridge: float = 0.0, name: str = "predicted", by: str = "series") -> DataFrame:
    """`df` (with `block`) and the least-squares forecast of `label` from `features`, fitted by `by` on earlier blocks; null in
    the first block and where fewer than `least` rows precede. Rows without a label are forecast but not learnt from.
    """
    value = [F.col(c).cast("double") for c in features]
    known = [x.isNotNull() & ~F.isnan(x) for x in value]
    z: list[Column] = [F.lit(1.0), *[F.when(k, x).otherwise(0.0) for k, x in zip(known, value, strict=True)], *[(~k).cast("double") for k in known]]
    p, y = len(z), F.col(label).cast("double")
    sums = df.where(y.isNotNull()).groupBy(by, "block").agg(
        F.array(*[F.sum(z[i] * z[j]) for i in range(p) for j in range(i, p)]).alias("gram"), F.array(*[F.sum(c * y) for c in z]).alias("target")
    )
    kind = dict(df.dtypes)[by]

    def solve(key, rows: pd.DataFrame) -> pd.DataFrame:  # a row a block
        out = _solved(rows, folds, len(features), least, ridge)
        out.insert(0, by, key[0])
        return out

    fits = sums.groupBy(by).applyInPandas(solve, f"{by} {kind}, block int, trained double, fit array<double>")
    rows = df.join(fits, [by, "block"], "left")
    at = lambda i: F.get("fit", F.lit(i))
    terms = at(0)
    for i, (k, x) in enumerate(zip(known, value, strict=True)):
        terms = terms + at(1 + i) * F.when(k, x).otherwise(at(p + i)) + at(1 + len(features) + i) * (~k).cast("double")
    return rows.withColumn(name, terms).drop("fit", "trained")


def error_summary(df: DataFrame, label: str, forecasts: list[str], by: list[str] | None = None) -> DataFrame:
    """n and mean absolute error of each forecast where it and the label are known."""
    long = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("forecast"), F.abs(F.col(c) - F.col(label)).alias("e")) for c in forecasts])).alias("_x")).select(*(by or []), "_x.*")
    return long.where(F.col("e").isNotNull()).groupBy(*(by or []), "forecast").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"))


def paired_gain(df: DataFrame, label: str, a: str, b: str, group: str, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """By how much the mean absolute error of `b` is below that of `a` on the rows that have both, with an interval from
    resampling whole groups (days): estimate, groups, low, high."""
    both = df.select(group, (F.abs(F.col(a) - F.col(label)) - F.abs(F.col(b) - F.col(label))).alias("_d"))
    return cluster_bootstrap(both, "_d", group, draws, level)
