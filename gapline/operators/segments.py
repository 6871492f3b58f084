"""Segments: two instruments' timelines on one grid, their targets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames, labels, windows
from .quantiles import quantiles


def _stretched(df: DataFrame, gap: int, name: str, by: str) -> DataFrame:
    """One row for each step from the first to the last of every run of rows at most `gap` steps apart."""
    runs = frames.runs(df.select(by, "k"), "k", F.lit(True), gap, by).groupBy(by, "run").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    return runs.select(by, F.lit(name).alias("source"), F.col("a").alias("segment"), F.explode(F.sequence("a", "z")).alias("k"))


def segments(soft: DataFrame, hard: DataFrame, gap: int, least: int, by: str = "series") -> DataFrame:
    """Full outer alignment of a soft and a hard timeline (series, k, x, coverage; one row an observed step).

    Each run of soft steps at most `gap` apart is a segment with the hard values that fall on it; runs of hard steps at least
    `least` long that no soft segment covers are segments of their own. Missing values are 0 with a mask of 0. Columns:
    source, segment (its first step), k, soft, soft_mask, hard, hard_mask.
    """
    of_soft = _stretched(soft, gap, "soft", by)
    left = _stretched(hard, gap, "hard", by).join(of_soft.select(by, "k"), [by, "k"], "left_anti")
    alone = frames.runs(left.withColumn("_o", F.col("segment")), "k", F.lit(True), 1, by)
    w = alone.groupBy(by, "_o", "run").agg(F.min("k").alias("segment"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    of_hard = alone.drop("segment").join(w, [by, "_o", "run"]).select(by, "source", "segment", "k")
    side = lambda df, n: df.select(by, "k", F.coalesce(F.col("x"), F.lit(0.0)).alias(n), F.when(F.col("coverage") > 0, 1).otherwise(0).alias(f"{n}_mask"))
    out = of_soft.union(of_hard).join(side(soft, "soft"), [by, "k"], "left").join(side(hard, "hard"), [by, "k"], "left")
    return out.fillna(0.0, ["soft", "hard"]).fillna(0, ["soft_mask", "hard_mask"])


def spans(rows: DataFrame, dt: float, by: str = "series") -> DataFrame:
    """Per segment: first and last step, steps, days, and the share of steps each instrument observed."""
    return rows.groupBy(by, "source", "segment").agg(
        F.max("k").alias("last"), F.count(F.lit(1)).alias("steps"), (F.count(F.lit(1)) * dt / 86400).alias("days"),
        F.avg("soft_mask").alias("soft_share"), F.avg("hard_mask").alias("hard_share"),
    )


def targets(grid: DataFrame, events: DataFrame, horizons: list[int], occurrence: list[int], half: int = 1, edges: tuple[float, ...] = (1, 3, 10, 30), width: int = 4096, by: str = "series") -> DataFrame:
    """All targets of each step of a dense grid (k, x; null: not observed): phase and magnitude class, log10 x at each horizon
    with its validity, and whether an event is under way within the next steps, valid where the step itself is observed and
    all those steps are on the grid."""
    seen = F.col("x").isNotNull()
    out = labels.phases(grid, events, half, width, by=by).join(labels.magnitude_class(grid.select(by, "k"), events, edges, width, by=by).select(by, "k", "magnitude"), [by, "k"])
    for h in horizons:
        ahead = grid.select(by, (F.col("k") - h).alias("k"), F.when(F.col("x") > 0, F.log10("x")).alias(f"y_{h}"), F.lit(True).alias("_there"))
        out = out.join(ahead, [by, "k"], "left").withColumn(f"valid_{h}", F.coalesce(seen & F.col("_there") & F.col(f"y_{h}").isNotNull(), F.lit(False))).drop("_there")
    last = grid.groupBy(by).agg(F.max("k").alias("_z"))
    out = out.join(last, by)
    for h in occurrence:
        out = windows.occurrence(out, h, F.col("phase") > 0, f"occurs_{h}", by=by)
        out = out.withColumn(f"occurs_{h}", F.coalesce(F.col(f"occurs_{h}").cast("int"), F.lit(0))).withColumn(f"occurs_valid_{h}", seen & (F.col("k") + h <= F.col("_z")))
    return out.drop("_z")


def rise_coverage(samples: DataFrame, steps: DataFrame, chunk: int = 4096, by: str = "series") -> DataFrame:
    """Per event the share of its sampled rise that `steps` (k, one row a step) hold: sums over samples of [onset, at), so early
    steps count once for each sample. `samples` has event, onset, at."""
    from . import temporal

    asked = samples.select(by, "event", F.col("onset").alias("start"), (F.col("at") - 1).alias("stop")).where("start <= stop")
    got = temporal.coverage(asked, steps, 1, chunk, by=by).withColumn("_n", F.col("stop") - F.col("start") + 1)
    return got.groupBy(by, "event").agg((F.sum(F.col("fraction") * F.col("_n")) / F.sum("_n")).alias("share"))


def summary(samples: DataFrame, lead: str = "lead", exceeds: str = "exceeds", event: str = "event") -> DataFrame:
    """One row on a set of rise samples: samples, events, median and greatest lead, share that exceeds, samples of an event."""
    per = samples.groupBy(event).agg(F.count(F.lit(1)).alias("_n"))
    counts = per.agg(F.count(F.lit(1)).alias("events"), F.min("_n").alias("fewest"), F.max("_n").alias("most")).withColumn("_one", F.lit(1))
    also = [F.count(F.lit(1)).alias("samples"), F.max(lead).alias("lead_max"), F.avg(F.col(exceeds).cast("double")).alias("positive")]
    whole = quantiles(samples, [], {"lead_median": (F.col(lead), 0.5)}, also).withColumn("_one", F.lit(1))
    return whole.join(counts, "_one").drop("_one")


def alert_labels(grid: DataFrame, events: DataFrame, early: int, steps: int, bar: float, width: int = 4096, by: str = "series") -> DataFrame:
    """`grid` (k, x) with label_c: an event is under way or starts within `early` steps, and label_m: the greatest x of the next
    `steps` reaches `bar`."""
    from . import temporal

    wide = events.select(by, (F.col("start") - early).alias("start"), "stop")
    out = temporal.inside(grid.withColumn("t", F.col("k")), wide, width, by=by).withColumnRenamed("inside", "label_c").drop("t")
    return windows.lookahead_max(out, steps, 1, "_top", by=by).withColumn("label_m", F.coalesce(F.col("_top") >= bar, F.lit(False))).drop("_top")


def described(rows: DataFrame, value: Column, t: str = "t", step: int = 600, by: str = "series") -> DataFrame:
    """Overview of a mission: per `step` seconds the greatest value and the median, and the number of samples."""
    return rows.groupBy(by, F.floor(F.col(t) / step).alias("k")).agg(F.max(value).alias("top"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"))


def daily_coverage(steps: DataFrame, dt: float, k: str = "k", by: str = "series") -> DataFrame:
    """Per day the share of its steps of `dt` seconds that are there."""
    one = steps.select(by, k).distinct()
    return one.groupBy(by, F.floor(F.col(k) * dt / 86400).alias("day")).agg((F.count(F.lit(1)) * dt / 86400).alias("share"))


def first_seen(flares: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The union of several flare lists with each flare once, as it stands in the first of them (`order`). Rows that `order` leaves
    equal stand by their other columns, least first, so that every run takes the same one."""
    w = W.partitionBy(key).orderBy(*order, *[F.col(c) for c in flares.columns if c != key])
    return flares.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def clipped(events: DataFrame, spans: DataFrame, dt: int, width: int = 1 << 20, by: str = "series") -> DataFrame:
    """Events (event, start, peak, stop in seconds) on the grids of the segments they meet (segment, first, last in seconds):
    first, peak and last step of each within the segment, and the event's own times."""
    from .temporal import _bucketed

    e = _bucketed(events.where("start <= stop"), width, F.col("start"), F.col("stop"))
    s = _bucketed(spans.withColumnsRenamed({"first": "_f", "last": "_l"}), width, F.col("_f"), F.col("_l"))
    met = e.join(s, [by, "_bucket"]).where((F.col("start") <= F.col("_l")) & (F.col("stop") >= F.col("_f"))).drop("_bucket").distinct()
    n = F.floor((F.col("_l") - F.col("_f")) / dt)
    at = lambda c, f: F.least(F.greatest(f((F.col(c) - F.col("_f")) / dt).cast("long"), F.lit(0)), n)
    return met.select(by, "segment", "event", "start", "peak", "stop", at("start", F.floor).alias("first"), at("peak", F.floor).alias("top"), at("stop", F.ceil).alias("last"))
