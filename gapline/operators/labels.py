"""Labels and targets from events on a grid: phases, magnitude classes, peaks, samples of rises, splits, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, temporal
from .quantiles import quantiles

QUIET, RISE, PEAK, DECAY = 0, 1, 2, 3


def phases(grid: DataFrame, events: DataFrame, half: int, width: int = 4096, k: str = "k", by: str = "series") -> DataFrame:
    """`grid` with phase: 0 quiet, 1 rise, 2 peak (peak +- `half` steps), 3 decay. The later event wins (order of `event`), and
    within an event the peak over the rise over the decay; the peak's window may reach outside its event."""
    part = lambda label, prio, a, z: F.struct(F.lit(label).alias("label"), F.lit(prio).alias("prio"), a.alias("a"), z.alias("z"))
    parts = F.array(
        part(DECAY, 0, F.col("peak"), F.col("stop")), part(RISE, 1, F.col("start"), F.col("peak") - 1), part(PEAK, 2, F.col("peak") - half, F.col("peak") + half)
    )
    spans = events.select(by, "event", F.explode(parts).alias("p")).select(by, "event", F.col("p.label").alias("label"), F.col("p.prio").alias("prio"), F.col("p.a").alias("start"), F.col("p.z").alias("stop"))
    hit = temporal.within(grid.select(by, k), spans, width, k, by).groupBy(f"p.{by}", f"p.{k}").agg(F.max_by("i.label", F.struct("i.event", "i.prio")).alias("phase"))
    return grid.join(hit, [by, k], "left").withColumn("phase", F.coalesce("phase", F.lit(QUIET)))


def bucket(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x (a missing x sorts last)."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return F.when(x.isNull() | F.isnan(x), F.lit(len(edges))).otherwise(out)


def magnitude_class(grid: DataFrame, events: DataFrame, edges: tuple[float, ...] = (1, 3, 10, 30), width: int = 4096, k: str = "k", by: str = "series") -> DataFrame:
    """`grid` with magnitude: 0 outside events, else the bucket of the latest event's magnitude."""
    spans = events.select(by, "event", "start", "stop", bucket(F.col("magnitude"), list(edges)).alias("cls"))
    hit = temporal.within(grid.select(by, k), spans, width, k, by).groupBy(f"p.{by}", f"p.{k}").agg(F.max_by("i.cls", "i.event").alias("magnitude"))
    return grid.join(hit, [by, k], "left").withColumn("magnitude", F.coalesce("magnitude", F.lit(0)))


def peak_targets(grid: DataFrame, events: DataFrame, dt: float, width: int = 4096, k: str = "k", by: str = "series") -> DataFrame:
    """Steps up to the peak of an event: hours to the peak and log10 of its value; the later event wins."""
    spans = events.select(by, "event", "start", F.col("peak").alias("stop"), "peak_value")
    hit = temporal.within(grid.select(by, k), spans, width, k, by).where("i.peak_value > 0")
    best = hit.groupBy(f"p.{by}", f"p.{k}").agg(F.max_by(F.struct("i.event", "i.stop", "i.peak_value"), "i.event").alias("e"))
    return best.select(by, k, "e.event", ((F.col("e.stop") - F.col(k)) * dt / 3600).alias("hours"), F.log10("e.peak_value").alias("log_peak"))


def rise_samples(events: DataFrame, lead: int, stride: int, share: float, q: float = 0.75, by: str = "series") -> DataFrame:
    """Samples along each rise: from start + lead every `stride` steps, at most `share` of the rise; with whether the peak's
    value reaches the percentile q of all peaks. Events whose rise is too short give none."""
    bar = quantiles(events, [], {"_bar": (F.col("peak_value"), q)})
    last = F.floor(F.col("start") + (F.col("peak") - F.col("start")) * share)
    rows = events.where(F.col("start") + lead <= last).withColumn("at", F.explode(F.sequence(F.col("start") + lead, last, F.lit(stride).cast("long"))))
    out = rows.join(F.broadcast(bar))  # one row
    return out.select(by, "event", "at", (F.col("peak") - F.col("at")).alias("to_peak"), (F.col("peak_value") >= F.col("_bar")).cast("int").alias("exceeds"))


def enumerate_windows(grid: DataFrame, length: int, stride: int, horizon: int, least: float = 0.5, k: str = "k", by: str = "series") -> DataFrame:
    """stop (exclusive) of each window of `length` steps, every `stride` from the series' start, that leaves `horizon` steps, has at
    least the share `least` of its steps observed (x not null), and an observed last step."""
    span = grid.groupBy(by).agg(F.min(k).alias("_a"), F.max(k).alias("_z"))
    seen = frames.framed(grid, k, length, 0, lambda w: {"n": F.count("x").over(w.rangeBetween(1 - length, 0))}, by)
    fine = seen.join(span, by).withColumn("stop", F.col(k) + 1)
    on = (F.col("stop") - F.col("_a") >= length) & ((F.col("stop") - F.col("_a") - length) % stride == 0) & (F.col("stop") + horizon <= F.col("_z") + 1)
    return fine.where(on & (F.col("n") >= least * length) & F.col("x").isNotNull()).select(by, "stop", (F.col("n") / length).alias("observed"))


def chronological_split(rows: DataFrame, embargo: int, train: float = 0.6, valid: float = 0.2, t: str = "stop", by: str = "series", chunk: int = 4096) -> DataFrame:
    """`rows` with part: the first floor(n * train) of a series' times are train, the next floor(n * valid) valid, the rest test; rows
    within `embargo` after the last row of the part before are left out."""
    counts = rows.groupBy(by, t).agg(F.count(F.lit(1)).alias("_n"))
    at = frames.running(counts, [F.col(t)], F.col("_n"), "_u", F.floor(F.col(t) / chunk), by).join(counts.groupBy(by).agg(F.sum("_n").alias("_all")), by)
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * train) + F.floor(F.col("_all") * valid)
    ends = at.groupBy(by).agg(F.max(F.when(F.col("_u") <= a, F.col(t))).alias("_ta"), F.max(F.when(F.col("_u") <= b, F.col(t))).alias("_tb"))
    ends = ends.select(by, F.coalesce("_ta", F.lit(-(2**62))).alias("_ta"), F.greatest(F.coalesce("_tb", F.lit(-(2**62))), F.coalesce("_ta", F.lit(-(2**62)))).alias("_tb"))
    part = F.when(F.col(t) <= F.col("_ta"), "train").when((F.col(t) <= F.col("_tb")) & (F.col(t) > F.col("_ta") + embargo), "valid").when(F.col(t) > F.greatest(F.col("_tb") + embargo, F.col("_ta") + embargo), "test")
    return rows.join(ends, by).withColumn("part", part).where(F.col("part").isNotNull()).drop("_ta", "_tb")


def ranked(events: DataFrame, t: str, by: str, chunk: int) -> DataFrame:
    """`events` with _r, the place in order of time (then event) within the series, and _n, how many it has."""
    rows = frames.running(events, [F.col(t), F.col("event")], F.lit(1), "_r", F.floor(F.col(t) / chunk), by)
    return rows.join(events.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by)


def event_split(events: DataFrame, train: float = 0.6, valid: float = 0.2, t: str = "peak", by: str = "series", chunk: int = 4096) -> DataFrame:
    """`events` with part by rank in time (then event): round(n * train) train, round(n * valid) valid, the rest test."""
    r, n = F.col("_r"), F.col("_n")
    part = F.when(r <= F.rint(n * train), "train").when(r <= F.rint(n * train) + F.rint(n * valid), "valid").otherwise("test")
    return ranked(events, t, by, chunk).withColumn("part", part).drop("_r", "_n")


def thin_quiet(windows: DataFrame, events: DataFrame, length: int, horizon: int, stride: int, keep: int, width: int = 4096, by: str = "series") -> DataFrame:
    """Windows that meet an event within [stop - length, stop + horizon), and one in `keep` of the quiet ones."""
    spans = windows.withColumn("start", F.col("stop") - length).withColumn("_stop", F.col("stop"))
    met = temporal.overlapping(spans.withColumn("stop", F.col("_stop") + horizon - 1), events, width, by)
    return met.where(F.col("overlaps") | (F.floor(F.col("_stop") / stride) % keep == 0)).withColumn("stop", F.col("_stop")).drop("start", "_stop", "overlaps")


def normalizer(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: centre (median) and scale (interquartile range / 1.349; the deviation where that is 0, else 1)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    q = quantiles(long, ["column"], {"q1": (F.col("x"), 0.25), "centre": (F.col("x"), 0.5), "q3": (F.col("x"), 0.75)}, [F.stddev_pop("x").alias("sd")])
    iqr = (F.col("q3") - F.col("q1")) / 1.349
    return q.select("column", "centre", F.when(iqr > 0, iqr).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def window_summary(grid: DataFrame, length: int, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Per step: last value, means over a twelfth, a quarter and all of the window, deviation, slope and availability."""

    def columns(w):
        full = w.rangeBetween(1 - length, 0)
        out = {f"mean_{n}": F.avg(x).over(w.rangeBetween(1 - n, 0)) for n in (length // 12, length // 4, length)}
        return out | {"sd": F.stddev_pop(x).over(full), "slope": F.regr_slope(F.col(x), F.col(k).cast("double")).over(full), "available": F.count(x).over(full) / length}

    return frames.framed(grid, k, length, 0, columns, by)


def folds(events: DataFrame, n: int, t: str = "peak", by: str = "series", chunk: int = 4096) -> DataFrame:
    """Rolling-origin folds: events in order of time in blocks of floor(n / (folds + 1)); fold f tests block f and trains before it."""
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / (n + 1)))
    return ranked(events, t, by, chunk).withColumn("block", F.least(F.lit(n), F.floor((F.col("_r") - 1) / size))).drop("_r", "_n")


def _portable(key: Column) -> Column:
    """A number in [0, 1) from a whole number by three steps of a multiplicative generator: the same in any engine."""
    m = F.lit(2_147_483_647)
    x = F.pmod(key, m) + 1
    for _ in range(3):
        x = F.pmod(x * 48_271, m)
    return x / 2_147_483_647.0


def sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """About the share `share` of the rows, chosen by their key alone: reruns and other partitionings choose the same."""
    return df.where(_portable(F.col(key)) < share)


def control_times(events: DataFrame, key: str, reach: int, clear: int, width: int, t: str = "t", by: str = "series") -> DataFrame:
    """For each event a time within `reach` of it, by its key; those closer than `clear` to any event are dropped. Columns: series, key, t."""
    moved = events.select(by, key, (F.col(t) + F.floor(_portable(F.col(key)) * 2 * reach) - reach).alias(t))
    near = temporal.nearest(moved, events.select(by, t).distinct().withColumn("_one", F.lit(1)), ["_one"], width, t=t, by=by)
    return near.where(F.col("distance").isNull() | (F.col("distance") >= clear)).select(by, key, t)


def climatology(df: DataFrame, value: str, event: str, cls: str) -> DataFrame:
    """Per class the mean over events of their own means, so that long events count no more than short ones."""
    each = df.where(F.col(value).isNotNull()).groupBy(cls, event).agg(F.avg(value).alias("_m"))
    return each.groupBy(cls).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("events"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str, event: str) -> DataFrame:
    """Two arms on the same samples: per event the mean of a's value less b's, and the number of pairs."""
    both = a.select(*keys, F.col(value).alias("_a"), F.col(event).alias("_e")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return both.groupBy(F.col("_e").alias(event)).agg(F.avg(F.col("_a") - F.col("_b")).alias("gain"), F.count(F.lit(1)).alias("pairs"))
