"""Joins in time: as-of, nearest, containment, overlap, attachment, merging of catalogues.

Range conditions are turned into equi-joins on buckets of time, so both sides are dealt by (series, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames


def asof(left: DataFrame, right: DataFrame, values: list[str], width: int, most: int | None = None, strict: bool = False, t: str = "t", by: str = "series", forward: bool = False, names: str = "asof_") -> DataFrame:
    """`left` with the columns `values` and t of the last row of `right` at or before each row (first at or after: `forward`).

    A whole record wins, nulls in it included. `most` is the greatest age (with `strict`, ages must be less). Of equal times
    the row with the greatest values wins (least, for `forward`). `width` is that of the chunks of time.
    """
    mine = F.struct(F.col(t), *[F.col(v) for v in values])
    side = lambda df, v, row, s: df.select(by, F.col(t), F.lit(s).alias("_side"), v.alias("_rec"), row.alias("_row"))
    whole = F.struct(*left.columns)
    rec = right.select(by, F.col(t), mine.alias("_rec"))
    both = side(left, F.lit(None).cast(rec.schema["_rec"].dataType), whole, 0 if forward else 1).union(rec.select(by, F.col(t), F.lit(1 if forward else 0).alias("_side"), "_rec", F.lit(None).cast(left.select(whole.alias("w")).schema["w"].dataType)))
    got = frames.carried(both, [F.col(t), F.col("_side"), F.col("_rec")], F.col("_rec"), "_got", F.floor(F.col(t) / width), by, last=not forward)
    out = got.where(F.col("_row").isNotNull()).select("_row.*", "_got")
    age = (F.col(f"_got.{t}") - F.col(t)) if forward else (F.col(t) - F.col(f"_got.{t}"))
    fine = F.lit(True) if most is None else (age < most if strict else age <= most)
    return out.select(*left.columns, *[F.when(fine, F.col(f"_got.{v}")).alias(f"{names}{v}") for v in (t, *values)])


def nearest(left: DataFrame, right: DataFrame, values: list[str], width: int, t: str = "t", by: str = "series", most: int | None = None) -> DataFrame:
    """`left` with nearest_t, `values` of the row of `right` nearest in time (ties to the earlier) and its distance; nulls where
    that is more than `most`."""
    back = asof(left, right, values, width, t=t, by=by, names="_b_")
    both = asof(back, right, values, width, t=t, by=by, names="_f_", forward=True)
    a, b = F.col(t) - F.col(f"_b_{t}"), F.col(f"_f_{t}") - F.col(t)
    first = b.isNull() | (a <= b)
    away = F.when(first, a).otherwise(b)
    fine = F.lit(True) if most is None else away <= most
    pick = lambda v: F.when(fine, F.when(first, F.col(f"_b_{v}")).otherwise(F.col(f"_f_{v}")))
    return both.select(*left.columns, *[pick(v).alias(f"nearest_{v}") for v in (t, *values)], F.when(fine, away).alias("distance"))


def _bucketed(intervals: DataFrame, width: int, start: Column, stop: Column) -> DataFrame:
    return intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(start / width), F.floor(stop / width))))


def within(points: DataFrame, intervals: DataFrame, width: int, t: str = "t", by: str = "series", closed: bool = True, how: str = "inner") -> DataFrame:
    """Pairs of points and the intervals (start, stop) that hold them."""
    spans = _bucketed(intervals.where("start <= stop"), width, F.col("start"), F.col("stop"))
    upto = F.col(f"p.{t}") <= F.col("i.stop") if closed else F.col(f"p.{t}") < F.col("i.stop")
    p = points.withColumn("_bucket", F.floor(F.col(t) / width))
    on = (F.col(f"p.{by}") == F.col(f"i.{by}")) & (F.col("p._bucket") == F.col("i._bucket")) & (F.col(f"p.{t}") >= F.col("i.start")) & upto
    return p.alias("p").join(spans.alias("i"), on, how)


def inside(points: DataFrame, intervals: DataFrame, width: int, t: str = "t", by: str = "series", closed: bool = True) -> DataFrame:
    """`points` with `inside`: whether any interval holds it. Overlapping intervals never multiply a point."""
    spans = intervals.where("start <= stop").select(by, "start", "stop").distinct()
    far = frames.running(spans, [F.col("start"), F.col("stop")], F.col("stop"), "far", F.floor(F.col("start") / width), by, "max")
    ends = far.groupBy(by, F.col("start").alias(t)).agg(F.max("far").alias("far"))
    got = asof(points, ends, ["far"], width, t=t, by=by, names="_i_")
    hit = F.col("_i_far") >= F.col(t) if closed else F.col("_i_far") > F.col(t)
    return got.withColumn("inside", F.coalesce(hit, F.lit(False))).drop(f"_i_{t}", "_i_far")


def overlapping(left: DataFrame, right: DataFrame, width: int, by: str = "series") -> DataFrame:
    """`left` (start, stop) with `overlaps`: whether any closed interval of `right` meets it: of those that start at or
    before its stop the furthest stop is at or after its start."""
    spans = right.where("start <= stop").select(by, "start", "stop").distinct()
    far = frames.running(spans, [F.col("start"), F.col("stop")], F.col("stop"), "far", F.floor(F.col("start") / width), by, "max")
    ends = far.groupBy(by, F.col("start").alias("_t")).agg(F.max("far").alias("far"))
    got = asof(left.withColumn("_t", F.col("stop")), ends, ["far"], width, t="_t", by=by, names="_o_")
    return got.withColumn("overlaps", F.coalesce(F.col("_o_far") >= F.col("start"), F.lit(False))).drop("_t", "_o__t", "_o_far")


def _at_ends(rows: DataFrame, ends: dict[str, Column], counts: DataFrame, chunk: int, t: str, by: str) -> DataFrame:
    """`rows` with _u_<name>: the running count `upto` of `counts` (series, t) at or before each of the ends, all in one as-of pass."""
    one = lambda n, c: F.struct(F.lit(n).alias("_end"), c.cast("long").alias(t))
    held = rows.withColumn("_row", F.struct(*rows.columns)).groupBy(by, "_row").agg(F.count(F.lit(1)).alias("_copies"))
    each = held.select(by, "_row", "_copies", F.struct("_row.*").alias("_x")).select("_x.*", "_row", "_copies")
    asked = each.select(by, "_row", "_copies", F.explode(F.array(*[one(n, c) for n, c in ends.items()])).alias("_e")).select(by, "_row", "_copies", "_e._end", F.col(f"_e.{t}").alias(t))
    got = asof(asked, counts.select(by, t, "upto"), ["upto"], chunk, t=t, by=by, names="_")
    wide = got.groupBy(by, "_row").agg(F.max("_copies").alias("_copies"), *[F.coalesce(F.max(F.when(F.col("_end") == n, F.col("_upto"))), F.lit(0)).alias(f"_u_{n}") for n in ends])
    return wide.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*", *[f"_u_{n}" for n in ends])


def coverage(intervals: DataFrame, steps: DataFrame, width: int, chunk: int = 4096, k: str = "k", by: str = "series") -> DataFrame:
    """`intervals` with `fraction`: observed steps (rows of `steps`, distinct) in [floor(start), floor(stop)] over all of them."""
    numbered = frames.running(steps.select(by, k).distinct(), [F.col(k)], F.lit(1), "upto", F.floor(F.col(k) / chunk), by)
    a, z = F.floor(F.col("start") / width), F.floor(F.col("stop") / width)
    both = _at_ends(intervals, {"a": a - 1, "z": z}, numbered.withColumnRenamed(k, "_k"), chunk, "_k", by)
    return both.select(*intervals.columns, ((F.col("_u_z") - F.col("_u_a")) / (z - a + 1)).alias("fraction"))


def attach_latest(points: DataFrame, events: DataFrame, width: int, early: int = 300, t: str = "t", by: str = "series") -> DataFrame:
    """`points` with `event`: that of the latest start (then greatest id) among events with t in [start - early, stop], or null.

    `events` has event, start, stop. One round of attaching a band's bursts to the catalogue.
    """
    wide = events.select(by, F.col("event"), F.col("start").alias("_s"), (F.col("start") - early).alias("start"), "stop")
    hits = within(points, wide, width, t, by).groupBy(*[F.col(f"p.{c}") for c in points.columns]).agg(F.max_by("i.event", F.struct("i._s", "i.event")).alias("event"))
    return points.join(hits, points.columns, "left")


def attach_bands(primary: DataFrame, bands: list[tuple[str, DataFrame, bool]], width: int, early: int = 300, by: str = "series") -> DataFrame:
    """Events from the bursts of several bands. `primary` has event, start, peak, stop, alert and band; each further band is
    (name, bursts with the same columns, whether a burst may stand alone). A burst joins the event of the latest start whose
    [start - early, stop] holds its peak: the event's alert is the earliest, its bands are listed in order, once each. A burst
    that joins none becomes an event after its round if it may stand alone. Columns: event, start, peak, stop, alert, bands.
    """
    out = primary.select(by, "event", "start", "peak", "stop", "alert", F.col("band").alias("bands"))
    for name, bursts, alone in bands:
        points = bursts.select(by, F.col("event").alias("_burst"), F.col("peak").alias("t"), F.col("alert").alias("_alert"))
        joined = attach_latest(points, out.select(by, "event", "start", "stop"), width, early, by=by)
        took = joined.where("event IS NOT NULL").groupBy(by, "event").agg(F.min("_alert").alias("_alert"))
        grown = out.join(took, [by, "event"], "left").select(by, "event", "start", "peak", "stop", F.least("alert", "_alert").alias("alert"), F.when(F.col("_alert").isNotNull(), F.concat_ws("+", "bands", F.lit(name))).otherwise(F.col("bands")).alias("bands"))
        if alone:
            rest = bursts.join(joined.where("event IS NULL").select(by, F.col("_burst").alias("event")), [by, "event"], "left_semi")
            grown = grown.union(rest.select(by, "event", "start", "peak", "stop", "alert", F.lit(name).alias("bands")))
        out = grown
    return out


def merge_catalogues(soft: DataFrame, hard: DataFrame, width: int, early: int = 300, by: str = "series") -> DataFrame:
    """Full outer merge with consumption: each hard event goes to the first soft event that can hold its peak.

    soft: soft (id), start, peak, stop; hard: hard (id), start, peak, stop, sigma. A soft event's best hard one has the greatest
    sigma (ties to the earlier peak); origin is soft+hard, soft or hard. Rows: origin, soft, hard, n_hard, start, peak.
    """
    wide = soft.select(by, "soft", F.col("start").alias("_s"), (F.col("start") - early).alias("start"), "stop")
    peaks = hard.select(by, "hard", F.col("peak").alias("t"), "sigma")
    held = within(peaks, wide, width).groupBy("p.hard", f"p.{by}", "p.t", "p.sigma").agg(F.min_by("i.soft", F.struct("i._s", "i.soft")).alias("soft"))
    best = held.groupBy(by, "soft").agg(F.max_by("hard", F.struct("sigma", -F.col("t"), -F.col("hard"))).alias("hard"), F.count(F.lit(1)).alias("n_hard"))
    left = soft.join(best, [by, "soft"], "left").select(by, F.when(F.col("hard").isNull(), "soft").otherwise("soft+hard").alias("origin"), "soft", "hard", F.coalesce("n_hard", F.lit(0)).alias("n_hard"), "start", "peak")
    alone = hard.join(held.select("hard"), "hard", "left_anti").select(by, F.lit("hard").alias("origin"), F.lit(None).cast("long").alias("soft"), "hard", F.lit(1).cast("long").alias("n_hard"), "start", "peak")
    return left.union(alone)


def exact(left: DataFrame, right: DataFrame, t: str = "t", by: str = "series", how: str = "inner") -> DataFrame:
    """Rows of both at the same time to the microsecond; times are seconds, whole or not."""
    us = F.rint(F.col(t) * 1_000_000).cast("long")
    return left.withColumn("_us", us).join(right.withColumn("_us", us).drop(t), [by, "_us"], how).drop("_us")


def on_days(flares: DataFrame, days: DataFrame, t: str = "t", by: str = "series") -> DataFrame:
    """`flares` whose day (t in seconds) is one of `days` (series, day number)."""
    return flares.withColumn("_day", F.floor(F.col(t) / 86400)).join(days.select(by, F.col("day").alias("_day")), [by, "_day"], "left_semi").drop("_day")


def settled_steps(predictions: DataFrame, steps: DataFrame, dt: float, settle: int, origin: str = "origin", by: str = "series") -> DataFrame:
    """`predictions` with the columns of the step (k) at the nearest multiple of dt, and pending: no such step yet, or the series
    ends before origin + settle."""
    k = F.rint(F.col(origin) / dt).cast("long")
    last = steps.groupBy(by).agg(F.max("k").alias("_last"))
    out = predictions.withColumn("k", k).join(steps.withColumn("_hit", F.lit(True)), [by, "k"], "left").join(last, by, "left")
    return out.withColumn("pending", F.col("_hit").isNull() | (F.col(origin) + settle > F.col("_last") * dt)).drop("_hit", "_last")


def hard_for(truth: DataFrame, hard: DataFrame, width: int, mode: str = "rise", early: int = 300, late: int = 300, shifts: tuple[int, ...] = (0,), by: str = "series") -> DataFrame:
    """`truth` (event, start, peak, stop) for each shift of `hard` (hard, start, peak) in time, with the hard event that peaks in
    [start - early, peak + late] (`mode` end: to the stop) and, for rise, starts in [start - early, peak]; of several the one
    whose peak is nearest (ties to the earlier). Shifts other than 0 are the control of what chance would match."""
    each = F.explode(F.array(*map(F.lit, shifts)))
    moved = hard.withColumn("shift", each).select(F.struct(by, "shift").alias("_s"), "hard", (F.col("start") + F.col("shift")).alias("hard_start"), (F.col("peak") + F.col("shift")).alias("t"))
    asked = truth.withColumn("shift", each)
    spans = asked.select(F.struct(by, "shift").alias("_s"), "event", (F.col("start") - early).alias("start"), (F.col("stop") if mode == "end" else F.col("peak") + late).alias("stop"), F.col("peak").alias("_peak"))
    pairs = within(moved, spans, width, by="_s")
    if mode == "rise":
        pairs = pairs.where(F.col("p.hard_start").between(F.col("i.start"), F.col("i._peak")))
    best = pairs.groupBy(F.col("i._s").alias("_s"), F.col("i.event").alias("event")).agg(F.min_by("p.hard", F.struct(F.abs(F.col("p.t") - F.col("i._peak")), F.col("p.t"), F.col("p.hard"))).alias("hard"))
    return asked.join(best.select(F.col(f"_s.{by}").alias(by), F.col("_s.shift").alias("shift"), "event", "hard"), [by, "shift", "event"], "left")


def slices(events: DataFrame, samples: DataFrame, before: int, after: int, width: int, t: str = "t", by: str = "series") -> DataFrame:
    """Samples in [start - before, stop + after] of each event: the event's id and the sample, with its time from the start."""
    wide = events.select(by, "event", F.col("start").alias("_s"), (F.col("start") - before).alias("start"), (F.col("stop") + after).alias("stop"))
    return within(samples, wide, width, t, by).select("i.event", "p.*", (F.col(f"p.{t}") - F.col("i._s")).alias("since")).drop("_bucket")


def trailing_counts(origins: DataFrame, events: DataFrame, spans: list[int], chunk: int, t: str = "t", by: str = "series") -> DataFrame:
    """`origins` with n_<span>: events in (t - span, t], from running counts taken as-of at all ends in one pass."""
    times = events.groupBy(by, F.col(t).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    ends = frames.running(times, [F.col("_k")], F.col("_n"), "upto", F.floor(F.col("_k") / chunk), by)
    out = _at_ends(origins, {str(s): F.col(t) - s for s in [0, *spans]}, ends, chunk, "_k", by)
    return out.select(*origins.columns, *[(F.col("_u_0") - F.col(f"_u_{s}")).alias(f"n_{s}") for s in spans])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
