"""Regular grids from irregular samples: rebinning with coverage, spines, gap filling, stitching of versions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames


def rebin(df: DataFrame, width: int, values: dict[str, Column], expected: float, least: float = 0.2, t: str = "t", by: str = "series") -> DataFrame:
    """series, k, the mean of each value over its valid (non-null) samples, and coverage.

    Coverage is a row's: samples with any valid value over `expected`, at most 1. Below `least` values are null, coverage 0.
    Bins without samples have no row.
    """
    any_valid = F.coalesce(*values.values()).isNotNull()
    binned = df.select(by, F.floor(F.col(t) / width).alias("k"), any_valid.alias("_ok"), *[v.alias(f"_{n}") for n, v in values.items()])
    means = binned.groupBy(by, "k").agg(F.least(F.lit(1.0), F.sum(F.col("_ok").cast("int")) / expected).alias("coverage"), *[F.avg(f"_{n}").alias(n) for n in values])
    seen = F.col("coverage") >= least
    return means.select(by, "k", *[F.when(seen, F.col(n)).alias(n) for n in values], F.when(seen, F.col("coverage")).otherwise(0.0).alias("coverage"))


def minutes(df: DataFrame, dt: int, x: str = "x", least: int = 2, t: str = "t", by: str = "series") -> DataFrame:
    """One-minute means: rate, counts (rate * 60), and valid where at least `least` bins of `dt` (or all, if fewer fit) have a value."""
    need = min(least, 60 // dt)
    out = df.groupBy(by, F.floor(F.col(t) / 60).alias("k")).agg(F.avg(x).alias("rate"), F.count(x).alias("n"))
    return out.select(by, "k", "rate", (F.col("rate") * 60).alias("counts"), (F.col("n") >= need).alias("valid"))


def spine(df: DataFrame, k: str = "k", by: str = "series") -> DataFrame:
    """Every grid step from the first to the last of each series, with the rows of `df` where there are any."""
    span = df.groupBy(by).agg(F.min(k).alias("_a"), F.max(k).alias("_z"))
    block = 1 << 14  # a long series is laid out in blocks, so that no row expands without bound
    blocks = span.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor(F.col("_z") / block))))
    steps = blocks.select(by, F.explode(F.sequence(F.greatest("_a", F.col("_b") * block), F.least("_z", F.col("_b") * block + block - 1))).alias(k))
    return steps.join(df, [by, k], "left")


def common_grid(parts: dict[str, DataFrame], k: str = "k") -> DataFrame:
    """Several series (k, x) on the union of their spans: a column for each, null where it has no value."""
    tagged = None
    for name, part in parts.items():
        one = part.select(k, F.lit(name).alias("_n"), F.col("x"))
        tagged = one if tagged is None else tagged.union(one)
    wide = tagged.groupBy(k).agg(*[F.max(F.when(F.col("_n") == n, F.col("x"))).alias(n) for n in parts])
    return spine(wide.withColumn("series", F.lit(0)), k).drop("series")


def interpolate(df: DataFrame, most: int, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Runs of at most `most` nulls between values are filled linearly; longer ones and ends stay null. `df` is dense."""
    at = F.when(F.col(x).isNotNull(), F.struct(F.col(k).alias("k"), F.col(x).alias("x")))

    def ends(w):
        return {"_l": F.last(at, True).over(w.rangeBetween(-most, 0)), "_r": F.first(at, True).over(w.rangeBetween(0, most))}

    both = frames.framed(df, k, most, most, ends, by)
    gap = F.col("_r.k") - F.col("_l.k") - 1
    line = F.col("_l.x") + (F.col("_r.x") - F.col("_l.x")) * (F.col(k) - F.col("_l.k")) / (F.col("_r.k") - F.col("_l.k"))
    return both.withColumn("filled", F.when(F.col(x).isNotNull(), F.col(x)).when(gap <= most, line)).drop("_l", "_r")


def uncovered(df: DataFrame, covered: Column, least: int, k: str = "k", by: str = "series") -> DataFrame:
    """first, last (inclusive) and n of each maximal run of at least `least` steps that are not covered. `df` is dense."""
    return frames.runs(df, k, ~covered, by=by).groupBy(by, "run").agg(F.min(k).alias("first"), F.max(k).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("run")


def sessions(files: DataFrame, gap: int, layout: str | None = None, by: str = "series", width: int = 1 << 18) -> DataFrame:
    """`files` (start, stop) with `segment`: a new one where a file starts more than `gap` after the furthest stop so far.

    With `layout`, a change of layout from one file to the next opens a segment as well.
    """
    keys, chunk = [F.col("start"), F.col("stop")], F.floor(F.col("start") / width)
    rows = frames.running(files, keys, F.col("stop"), "_far", chunk, by, "max", strict=True)
    opens = F.col("_far").isNull() | (F.col("start") > F.col("_far") + gap)
    if layout:  # the layout of the file before: within the chunk, else the last of the chunks before
        w = W.partitionBy(by, "_c").orderBy(*keys)
        rows = rows.withColumn("_c", chunk)
        ends = rows.groupBy(by, "_c").agg(F.max_by(F.struct(layout), F.struct(*keys)).alias("_e"))
        before = ends.select(by, "_c", F.lag("_e").over(W.partitionBy(by).orderBy("_c")).alias("_p"))
        rows = rows.withColumn("_i", F.lag(F.struct(layout)).over(w)).join(before, [by, "_c"])
        last = F.coalesce("_i", "_p")
        opens = opens | (last.isNotNull() & ~F.col(layout).eqNullSafe(last[layout]))
    numbered = frames.running(rows.withColumn("_o", opens.cast("int")), keys, F.col("_o"), "segment", chunk, by)
    return numbered.select(*files.columns, "segment")


def stitch(rows: DataFrame, values: list[str], by: str = "series") -> DataFrame:
    """One row for each bin: of the rows with coverage, the highest priority, then the best coverage, then the earliest file."""
    best = F.max_by(F.struct(*values, "priority", "coverage", "file"), F.struct("priority", "coverage", -F.col("file")))
    return rows.where(F.col("coverage") > 0).groupBy(by, "k").agg(best.alias("_b")).select(by, "k", "_b.*")


def merge_detectors(rows: DataFrame, detectors: list[str], values: list[str], by: str = "series") -> DataFrame:
    """Per bin and detector the row with the best coverage (ties to the earliest file); a column for each detector and value.

    The row's coverage is the greatest of its detectors'; a detector without rows has null values and coverage 0.
    """
    best = F.max_by(F.struct(*values, "coverage"), F.struct("coverage", -F.col("file")))
    one = rows.groupBy(by, "k", "detector").agg(best.alias("_b"))
    wide = one.groupBy(by, "k").agg(*[F.max(F.when(F.col("detector") == d, F.col(f"_b.{v}"))).alias(f"{d}_{v}") for d in detectors for v in (*values, "coverage")], F.max("_b.coverage").alias("coverage"))
    return wide.fillna(0.0, [f"{d}_coverage" for d in detectors])


def blocks(df: DataFrame, size: int, x: str = "x", k: str = "k", by: str = "series") -> DataFrame:
    """Sums over whole blocks of `size` steps; a block with steps missing is dropped."""
    out = df.groupBy(by, F.floor(F.col(k) / size).alias("block")).agg(F.sum(x).alias("total"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == size).drop("_n")


def marked(intervals: DataFrame, width: int, by: str = "series") -> DataFrame:
    """series, k of each grid step inside any closed interval (start, stop): from ceil(start) to floor(stop), by differences."""
    a, z = F.ceil(F.col("start") / width), F.floor(F.col("stop") / width)
    fine = intervals.select(by, a.alias("a"), z.alias("z")).where("a <= z")
    edges = fine.select(by, F.col("a").alias("k"), F.lit(1).alias("d")).union(fine.select(by, (F.col("z") + 1).alias("k"), F.lit(-1).alias("d"))).groupBy(by, "k").agg(F.sum("d").alias("d"))
    depth = frames.running(edges, [F.col("k")], F.col("d"), "depth", F.floor(F.col("k") / 4096), by)
    spans = depth.withColumn("next", F.lead("k").over(W.partitionBy(by).orderBy("k"))).where("depth > 0")
    return spans.select(by, F.explode(F.sequence("k", F.col("next") - 1)).alias("k"))


def observed_time(df: DataFrame, dt: int, t: str = "t", by: str = "series") -> DataFrame:
    """series, day (yyyy-MM-dd) and observed seconds: distinct steps of `dt` with a sample."""
    steps = df.select(by, F.floor(F.col(t) / dt).alias("k")).distinct()
    day = F.date_from_unix_date(F.floor(F.col("k") * dt / 86400).cast("int")).cast("string")
    return steps.groupBy(by, day.alias("day")).agg((F.count(F.lit(1)) * dt).alias("seconds"))
