"""Hourly activity of a series and day-ahead targets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, spans, temporal, walks


def hourly(df: DataFrame, step: int, hours: tuple[int, ...] = (1, 6, 24), t: str = "t", x: str = "x", by: str = "series") -> DataFrame:
    """Per hour with a sample in it: the last value and min, max and mean over (t - h, t] of each span, at the hour's last sample."""
    seen = df.where(F.col(x).isNotNull())
    last = seen.groupBy(by, F.floor(F.col(t) / 3600).alias("hour")).agg(F.max(t).alias(t), F.max_by(x, F.struct(t, x)).alias("now"))
    both = seen.select(by, t, x).withColumns({"hour": F.lit(None).cast("long"), "now": F.lit(None).cast(df.schema[x].dataType)}).unionByName(last.withColumn(x, F.lit(None).cast(df.schema[x].dataType)))
    names = [f"{how}_{h}h" for h in hours for how in ("min", "max", "mean")]

    def measure(ts, xs, at):
        out = {}
        for h in hours:
            a, z = spans.bounds(ts, at - (h * 3600 - 1), at)
            out |= {f"min_{h}h": spans.extremes(xs, a, z, np.fmin), f"max_{h}h": spans.extremes(xs, a, z), f"mean_{h}h": spans.sums(xs, a, z) / np.maximum(z - a, 1)}
        return out

    out = spans.measured(both, measure, ", ".join(f"{n} double" for n in names), max(hours) * 3600, asked=F.col("hour").isNotNull(), x=x, t=t, by=by)
    return out.select(by, "hour", "now", *names)


def event_counts(origins: DataFrame, events: DataFrame, hours: tuple[int, ...] = (6, 24, 72), chunk: int = 1 << 20, t: str = "t", by: str = "series") -> DataFrame:
    """`origins` with n_<seconds> of events in (t - h, t]."""
    return temporal.trailing_counts(origins, events, [h * 3600 for h in hours], chunk, t, by)


def hours_since(origins: DataFrame, events: DataFrame, cap: float = 168.0, chunk: int = 1 << 20, t: str = "t", by: str = "series") -> DataFrame:
    """`origins` with hours since the last event at or before t, `cap` at most and where there is none."""
    last = temporal.asof(origins, events.select(by, t).distinct().withColumn("_one", F.lit(1)), ["_one"], chunk, t=t, by=by, names="_e_")
    return last.withColumn("hours_since", F.coalesce(F.least((F.col(t) - F.col(f"_e_{t}")) / 3600.0, F.lit(cap)), F.lit(cap))).drop(f"_e_{t}", "_e__one")


def day_ahead(origins: DataFrame, events: DataFrame, steps: DataFrame, horizon: int, width: int, least: float = 0.8, chunk: int = 1 << 20, t: str = "t", by: str = "series") -> DataFrame:
    """`origins` with target: 1 where an event lies in (t, t + horizon], else 0; null where less than the share `least` of the
    steps (k, of `width` seconds) in it is observed."""
    shifted = origins.withColumn("_t", F.col(t) + horizon)
    n = temporal.trailing_counts(shifted, events.select(by, F.col(t).alias("_t")), [horizon], chunk, "_t", by)
    spans = n.withColumn("start", F.col(t) + width).withColumn("stop", F.col("_t"))
    seen = temporal.coverage(spans, steps, width, by=by)
    return seen.withColumn("target", F.when(F.col("fraction") >= least, (F.col(f"n_{horizon}") > 0).cast("int"))).drop("_t", "start", "stop", f"n_{horizon}")


def lagged(df: DataFrame, lag: int, columns: list[str], k: str = "hour", by: str = "series") -> DataFrame:
    """`df` with d_<column>: the change over `lag` steps, null where there is no row that far back."""
    out = frames.framed(df, k, lag, 0, lambda w: {f"_{c}": F.first(c).over(w.rangeBetween(-lag, -lag)) for c in columns}, by)
    return out.withColumns({f"d_{c}": F.col(c) - F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def forecaster(train: DataFrame, features: list[str], label: str, kind: str = "logistic"):
    """A fitted pipeline (standardised logistic regression, or boosted trees) over rows without nulls in `features`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    model = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=0.01) if kind == "logistic" else GBTClassifier(featuresCol="scaled", labelCol=label, maxIter=30, maxDepth=4, seed=1)
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model]
    return Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))


def importance(scored: DataFrame, model, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """Loss of the rank score when one feature's values are dealt anew among rows (by a hash order): feature, drop."""
    from pyspark.ml.functions import vector_to_array

    from .metrics import roc_auc

    score = lambda d: roc_auc(model.transform(d).withColumn("_p", vector_to_array("probability")[1]), label, "_p").select("auc")
    rows = scored
    for name, s in (("_a", seed), ("_b", seed + 1)):  # places in two hash orders, by ranges of the hash
        h = F.xxhash64(*features, F.lit(s))
        rows = frames.running(rows.withColumn("_h", h), [F.col("_h")], F.lit(1), name, F.shiftright("_h", 50)).drop("_h")
    rows = walks.written(rows, "places")  # equal hashes keep their places
    out = None
    for f in features:
        other = rows.select("series", F.col("_b").alias("_a"), F.col(f).alias("_f"))
        moved = rows.drop(f).join(other, ["series", "_a"]).withColumnRenamed("_f", f)
        one = score(rows).join(score(moved).withColumnRenamed("auc", "_m")).select(F.lit(f).alias("feature"), (F.col("auc") - F.col("_m")).alias("drop"))
        out = one if out is None else out.union(one)
    return out
