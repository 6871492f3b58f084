"""Scoring windows by a model that the caller brings, and freezing what a score depends on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames


def with_window(grid: DataFrame, length: int, columns: list[str], k: str = "k", by: str = "series") -> DataFrame:
    """`grid` with `window`: the last `length` steps of each of `columns`, oldest first, missing values and steps before the series as 0, and
    `mask` of what was observed. Windows are laid out only for rows that are kept; filter first."""
    size = length

    def at(w):
        f = w.rangeBetween(1 - length, 0)
        return {f"_{c}": F.collect_list(F.struct(F.col(k).alias("k"), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias("x"), (F.col(c).isNotNull() & ~F.isnan(c)).cast("double").alias("m"))).over(f) for c in columns}

    out = frames.framed(grid, k, length, 0, at, by)
    pad = lambda a: F.concat(F.array_repeat(F.lit(0.0), size - F.size(a)), a)
    return out.withColumn("window", F.concat(*[pad(F.transform(f"_{c}", lambda s: s["x"])) for c in columns])).withColumn("mask", F.concat(*[pad(F.transform(f"_{c}", lambda s: s["m"])) for c in columns])).drop(*[f"_{c}" for c in columns])


def scored(windows: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str = "score", batch: int = 4096, window: str = "window") -> DataFrame:
    """`windows` with a score from the model that `make` loads once a worker; batches are arrays of (rows, window)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    def loader():
        predict = make()
        return lambda x: np.asarray(predict(np.asarray(x)), dtype=np.float64)

    width = windows.select(F.max(F.size(window)).alias("n")).first()["n"] or 1
    return windows.withColumn(name, predict_batch_udf(loader, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])(window))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of what a forecast was made with, to be stored beside it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
