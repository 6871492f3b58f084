"""Choosing among files and records: newest version, best overlap, flare records, hourly region sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gapline.functions import clocks, scalars
from gapline.operators import masks, temporal


def newest(files: DataFrame, keys: list[str], version: Column, prefer: Column, path: str = "path") -> DataFrame:
    """One file for each key: the highest version (part by part), `prefer` on ties, then the first path."""
    rank = [version.desc(), prefer.desc(), F.col(path).asc()]
    return temporal.first_per_key(files, keys, rank)


def best_overlap(spans: DataFrame, products: DataFrame, width: int, by: str = "series") -> DataFrame:
    """Per span (id, start, stop) the product with the longest overlap in whole seconds, ties to the higher version, then the
    later path; spans without any have no row."""
    p = products.where("start <= stop").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    s = spans.where("start <= stop").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    both = s.alias("s").join(p.alias("p"), [by, "_b"]).where((F.col("s.start") < F.col("p.stop")) & (F.col("p.start") < F.col("s.stop")))
    over = F.rint(F.least("s.stop", "p.stop") - F.greatest("s.start", "p.start"))
    best = F.max_by(F.struct(F.col("p.path").alias("path"), over.alias("overlap")), F.struct(over, F.col("p.version"), F.col("p.path")))
    return both.groupBy(by, "s.id").agg(best.alias("b")).select(by, "id", "b.*")


def flare_list(records: DataFrame, by: str = "series") -> DataFrame:
    """One row a flare from START, PEAK and END records (flare, status, t, value, row): first start, last peak, first end.

    A missing end is estimated: the later of 600 s and twice the rise after the peak, but not beyond the next flare's start
    (60 s after the peak at least); `estimated` tells. Flares without a peak are dropped; a missing start is the peak.
    """
    at = lambda s, f: f(F.when(F.col("status") == s, F.struct("t", "value")), F.when(F.col("status") == s, F.col("row")))
    wide = records.groupBy(by, "flare").agg(at("START", F.min_by).alias("s"), at("PEAK", F.max_by).alias("p"), at("END", F.min_by).alias("e")).where(F.col("p").isNotNull())
    rows = wide.select(by, "flare", F.coalesce("s.t", "p.t").alias("start"), F.col("p.t").alias("peak"), F.col("e.t").alias("stop"), F.col("p.value").alias("value"))
    following = F.lead("start").over(W.partitionBy(by).orderBy("peak", "flare"))
    guess = F.col("peak") + F.greatest(2 * (F.col("peak") - F.col("start")), F.lit(600))
    held = F.least(guess, F.greatest(following, F.col("peak") + 60))
    return rows.withColumn("estimated", F.col("stop").isNull()).withColumn("_g", held).withColumn("stop", F.coalesce("stop", "_g")).drop("_g")


def flux_minutes(rows: DataFrame, by: str = "series") -> DataFrame:
    """One row a time (t, flux, flag, file, row): flux null where flagged, not finite or not positive; of repeated times the first
    file's first row."""
    flux = F.when((F.col("flag") == 0) & (F.col("flux") > 0) & (F.col("flux") < float("inf")), F.col("flux"))
    return temporal.first_per_key(rows, [by, "t"], [F.col("file"), F.col("row")]).select(by, "t", flux.alias("flux"))


def region_hours(rows: DataFrame, sums: list[str], tops: list[str], keep: Column, t: str = "t") -> DataFrame:
    """Per hour: regions, log10 of the sums of `sums` (null where not positive) and the greatest of `tops`."""
    total = [F.sum(c) for c in sums]
    out = rows.where(keep).groupBy(F.floor(F.col(t) / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("regions"), *[s.alias(f"_{c}") for s, c in zip(total, sums, strict=True)], *[F.max(c).alias(f"max_{c}") for c in tops])
    return out.select("hour", "regions", *[F.when(F.col(f"_{c}") > 0, F.log10(f"_{c}")).alias(f"log_{c}") for c in sums], *[f"max_{c}" for c in tops])


def active_regions(rows: DataFrame) -> DataFrame:
    """Monthly region rows (T_REC, QUALITY, LON_FWT, USFLUX, TOTPOT, R_VALUE) as hourly sums of the fine ones."""
    t = rows.withColumn("t", clocks.from_tai(F.col("T_REC"))).where(F.col("t").isNotNull())
    return region_hours(t, ["USFLUX", "TOTPOT"], ["R_VALUE"], masks.fine_rows(F.col("QUALITY"), F.col("LON_FWT")))


def outside_events(rows: DataFrame) -> DataFrame:
    """Flares of an outside list with whatever of the usual column names it has: start, peak, stop, cls, flux; stop = peak if missing."""
    have = {c.lower(): c for c in rows.columns}
    pick = lambda *names: F.coalesce(*[F.col(have[n]).cast("string") for n in names if n in have] or [F.lit(None).cast("string")])
    t = lambda *names: clocks.seconds(clocks.parsed(pick(*names)))
    cls = pick("max_class", "fl_goescls", "goes_class", "class")
    out = rows.select(t("begin_time", "event_starttime", "start_time", "start").alias("start"), t("max_time", "event_peaktime", "peak_time", "peak").alias("peak"), t("end_time", "event_endtime", "stop_time", "end").alias("stop"), cls.alias("cls"))
    return out.where(F.col("peak").isNotNull()).withColumn("stop", F.coalesce("stop", "peak")).withColumn("flux", scalars.class_flux(F.col("cls")))
