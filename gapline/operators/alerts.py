"""Alerts on a minute grid: windows before peaks, false alarms a day, lead times, operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import detect, frames, temporal
from .metrics import ratio
from .quantiles import quantiles


def windows_before(events: DataFrame, steps: DataFrame, early: int = 30, least: float = 0.8, by: str = "series") -> DataFrame:
    """The window in which an alert of each event counts: from `early` minutes before the start, but after the previous peak, to
    the peak; with the share of its minutes observed, at least `least`. `events` has event, start, peak (minutes)."""
    rows = frames.running(events, [F.col("peak"), F.col("event")], F.col("peak"), "_before", F.floor(F.col("peak") / 4096), by, "max", strict=True)
    spans = rows.withColumn("_s", F.greatest(F.col("start") - early, F.coalesce(F.col("_before") + 1, F.col("start") - early)))
    spans = spans.select(by, "event", F.col("_s").alias("start"), F.col("peak").alias("stop")).where("start <= stop")
    return temporal.coverage(spans, steps, 1, by=by).where(F.col("fraction") >= least)


def shifted(spans: DataFrame, events: DataFrame, shifts: list[int], width: int = 4096, by: str = "series") -> DataFrame:
    """Copies of the windows at other times that meet no event: what chance alone would warn of."""
    moved = spans.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("start", F.col("start") + F.col("shift")).withColumn("stop", F.col("stop") + F.col("shift"))
    return temporal.overlapping(moved, events, width, by).where("NOT overlaps").drop("overlaps")


def false_alarms(df: DataFrame, on: Column, events: DataFrame, early: int = 15, late: int = 30, k: str = "k", by: str = "series", width: int = 4096) -> DataFrame:
    """Episodes that meet no event (with a margin of `early` and `late` minutes), a day of minutes; and the share of time on."""
    eps = detect.episodes(df, on, 6, k, by)
    wide = events.select(by, (F.col("start") - late).alias("start"), (F.col("stop") + early).alias("stop"))
    judged = temporal.overlapping(eps, wide, width, by)
    days = df.groupBy(by).agg((F.count(F.lit(1)) / 1440).alias("days"), F.avg(F.coalesce(on, F.lit(False)).cast("double")).alias("duty"))
    n = judged.groupBy(by).agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(~F.col("overlaps"), 1)).alias("false"))
    return days.join(n, by, "left").fillna(0, ["episodes", "false"]).withColumn("false_per_day", ratio(F.col("false").cast("double"), F.col("days")))


def lead_times(df: DataFrame, on: Column, spans: DataFrame, k: str = "k", by: str = "series", chunk: int = 4096) -> DataFrame:
    """`spans` (event, start, stop) with warned and lead: minutes from the first step on within the window to its end."""
    first = df.where(on).select(by, F.col(k).alias("_k"), F.col(k).alias("_on"))  # steps that are on, and no others, meet the windows
    got = temporal.asof(spans.withColumn("_k", F.col("start")), first, ["_on"], chunk, t="_k", by=by, names="_n_", forward=True)
    hit = F.col("_n__on") <= F.col("stop")
    return got.withColumn("warned", F.coalesce(hit, F.lit(False))).withColumn("lead", F.when(hit, F.col("stop") - F.col("_n__on"))).drop("_k", "_n__k", "_n__on")


def lead_summary(leads: DataFrame, by: str = "series") -> DataFrame:
    """Share warned, quartiles of the lead, shares of leads of at least 5 and 10 minutes."""
    share = lambda m: F.avg(F.coalesce((F.col("lead") >= m).cast("double"), F.lit(0.0)))
    asked = {f"lead_q{int(q * 100)}": (F.col("lead"), q) for q in (0.25, 0.5, 0.75)}
    return quantiles(leads, [by], asked, [F.count(F.lit(1)).alias("n"), F.avg(F.col("warned").cast("double")).alias("tpr"), share(5).alias("lead_5"), share(10).alias("lead_10")])


def alarm_episodes(df: DataFrame, scores: dict[str, str], thresholds: list[float], gap: int = 6, k: str = "k", by: str = "series") -> DataFrame:
    """arm, threshold, start and stop of the episodes of every score (a column for each arm) at every threshold, in one pass.

    A step's level is how many thresholds its score reaches. It starts an episode at those levels that no step within `gap` before
    it reaches, and ends one at those that none within `gap` after it does; so a row is made for each episode, not for each step.
    """
    steps = sorted(thresholds)
    reached = lambda c: F.coalesce(sum((F.col(c) >= t).cast("int") for t in steps), F.lit(0))
    cols = {a: f"_l{i}" for i, a in enumerate(scores)}
    levels = df.select(by, k, *[reached(c).alias(cols[a]) for a, c in scores.items()])

    def around(w):
        before, after = w.rangeBetween(-gap, -1), w.rangeBetween(1, gap)
        return {f"{c}{n}": F.coalesce(F.max(c).over(f), F.lit(0)) for c in cols.values() for n, f in (("b", before), ("a", after))}

    seen = frames.framed(levels, k, gap, gap, around, by)

    def edges_of(arm: str, c: str) -> list[Column]:
        """Arrays of (arm, level, first): the levels that start and those that end at a step."""
        parts = []
        for n, first in (("b", True), ("a", False)):
            levels = F.when(F.col(c) > F.col(f"{c}{n}"), F.sequence(F.col(f"{c}{n}") + 1, F.col(c))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(levels, lambda j: F.struct(F.lit(arm).alias("arm"), j.alias("level"), F.lit(first).alias("first"))))  # noqa: B023
        return parts

    each = F.concat(*[x for a, c in cols.items() for x in edges_of(a, c)])
    edges = seen.select(by, k, F.explode(each).alias("e")).select(F.struct(by, "e.arm", "e.level").alias("_g"), F.col(k).alias("_k"), "e.first")
    # starts and ends of a level take turns: an episode ends at the first end from its start on
    ends = frames.carried(edges, [F.col("_k"), F.col("first").cast("int") * -1], F.when(~F.col("first"), F.col("_k")), "_stop", F.floor(F.col("_k") / 4096), "_g", last=False)
    at = F.get(F.array(*map(F.lit, steps)), F.col("_g.level") - 1)
    return ends.where("first").select(F.col(f"_g.{by}").alias(by), "_g.arm", at.alias("threshold"), F.col("_k").alias("start"), F.col("_stop").alias("stop"))


def operating_curves(df: DataFrame, scores: dict[str, str], thresholds: list[float], events: DataFrame, spans: DataFrame, most: float, early: int = 15, late: int = 30, k: str = "k", by: str = "series", width: int = 4096) -> DataFrame:
    """Per arm (a column of scores) and threshold: false alarms a day and share of windows warned, over all series; `chosen` is
    the arm's least threshold with at most `most` false alarms a day.

    The grid is read once for all arms and thresholds: what a window is warned of follows from the greatest score in it.
    """
    wide = events.select(by, (F.col("start") - late).alias("start"), (F.col("stop") + early).alias("stop"))
    judged = temporal.overlapping(alarm_episodes(df, scores, thresholds, 6, k, by), wide, width, by)
    false = judged.where(~F.col("overlaps")).groupBy("arm", "threshold").agg(F.count(F.lit(1)).alias("false"))
    inside = temporal.within(df.select(by, F.col(k).alias("t"), *scores.values()), spans.select(by, "event", "start", "stop"), width, "t", by)
    tops = inside.groupBy(F.col(f"i.{by}").alias(by), F.col("i.event").alias("event")).agg(*[F.max(F.col(f"p.{c}")).alias(f"_t{i}") for i, c in enumerate(scores.values())])
    windows_of = spans.select(by, "event").join(tops, [by, "event"], "left")
    points = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("threshold"), F.coalesce(F.col(f"_t{i}") >= t, F.lit(False)).alias("warned")) for i, a in enumerate(scores) for t in thresholds]))
    warned = windows_of.select(points.alias("_p")).groupBy("_p.arm", "_p.threshold").agg(F.avg(F.col("_p.warned").cast("double")).alias("tpr"))
    days = df.agg((F.count(F.lit(1)) / 1440).alias("_days"))  # one row
    every = df.sparkSession.createDataFrame([(a, float(t)) for a in scores for t in thresholds], "arm string, threshold double")
    out = every.join(false, ["arm", "threshold"], "left").join(warned, ["arm", "threshold"], "left").join(F.broadcast(days)).fillna(0, ["false"])
    out = out.withColumn("false_per_day", ratio(F.col("false").cast("double"), F.col("_days")))
    fine = F.min(F.when(F.col("false_per_day") <= most, F.col("threshold"))).over(W.partitionBy("arm"))  # a row a threshold
    return out.withColumn("chosen", F.coalesce(F.col("threshold") == fine, F.lit(False))).drop("_days")


def operating_points(df: DataFrame, score: str, thresholds: list[float], events: DataFrame, spans: DataFrame, most: float, k: str = "k", by: str = "series") -> DataFrame:
    """The operating curve of one score: threshold, false, tpr, false_per_day and chosen."""
    return operating_curves(df, {"": score}, thresholds, events, spans, most, k=k, by=by).drop("arm")


def trend(df: DataFrame, back: int = 5, ahead: int = 15, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """`df` with trend: the value `ahead` steps on if the rise of the last `back` steps (not less than 0) went on."""
    from . import frames

    out = frames.framed(df, k, back, 0, lambda w: {"_b": F.first(x).over(w.rangeBetween(-back, -back))}, by)
    return out.withColumn("trend", F.col(x) + ahead / back * F.greatest(F.col(x) - F.col("_b"), F.lit(0.0))).drop("_b")
