"""Verification reports as tables: recall with its chance control, evaluation by arm, onset statistics, repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alerts, metrics
from .quantiles import quantiles


def recall(found: DataFrame, cls: str = "cls", by: tuple[str, ...] = ("shift",)) -> DataFrame:
    """Share of truths found by class for each shift; shifts other than 0 are what chance finds."""
    return found.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("recall"))


def gain_over_chance(rates: DataFrame, cls: str = "cls") -> DataFrame:
    """Recall at shift 0, the mean of the other shifts, and their difference, by class."""
    now, chance = F.max(F.when(F.col("shift") == 0, F.col("recall"))), F.avg(F.when(F.col("shift") != 0, F.col("recall")))
    return rates.groupBy(cls).agg(now.alias("recall"), chance.alias("chance")).withColumn("gain", F.col("recall") - F.col("chance"))


def precision(events: DataFrame, matched: Column, floors: dict[str, Column], days: float) -> DataFrame:
    """Per floor: events at or above it, share matched, and unmatched ones a day."""
    aggs = [x for name, at in floors.items() for x in (F.count(F.when(at, 1)).alias(f"{name}_n"), F.avg(F.when(at, matched.cast("double"))).alias(f"{name}_share"), (F.count(F.when(at & ~matched, 1)) / days).alias(f"{name}_a_day"))]
    wide = events.agg(*aggs)
    one = lambda n: F.struct(F.lit(n).alias("floor"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_share").alias("precision"), F.col(f"{n}_a_day").alias("unmatched_a_day"))
    return wide.select(F.explode(F.array(*map(one, floors))).alias("r")).select("r.*")


def agreement(pairs: DataFrame, mine: str, truth: str, letter: Column) -> DataFrame:
    """By the truth's class letter: matched, share of equal letters, median bias and median size of the error, in decades."""
    dex = F.log10(mine) - F.log10(truth)
    known = pairs.where((F.col(mine) > 0) & (F.col(truth) > 0)).select(letter.alias("cls"), dex.alias("_dex"))
    return quantiles(known, ["cls"], {"bias": (F.col("_dex"), 0.5), "error": (F.abs("_dex"), 0.5)}, [F.count(F.lit(1)).alias("n")])


def evaluation(rows: DataFrame, y: str, p: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, skill at a fixed threshold, Brier score and its skill over the base rate, per group."""
    hit, truth = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    out = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(n(hit & truth).alias("tp"), n(hit & ~truth).alias("fp"), n(~hit & truth).alias("fn"), n(~hit & ~truth).alias("tn"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(F.col(y).cast("double")).alias("base"))
    s = metrics.skill(*map(F.col, ("tp", "fp", "fn", "tn")))
    skill = metrics.ratio(F.col("base") * (1 - F.col("base")) - F.col("brier"), F.col("base") * (1 - F.col("base")))
    return out.select(*by, "tp", "fp", "fn", "tn", *[c.alias(k) for k, c in s.items() if k in ("tss", "hss")], "brier", skill.alias("brier_skill"))


def ablation(rows: DataFrame, y: str, arms: dict[str, str], threshold: float) -> DataFrame:
    """The evaluation of each arm, a column of scores made with some inputs left out, over the same rows."""
    long = rows.select(y, F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).alias("p")) for a, c in arms.items()])).alias("a")).select(y, "a.*")
    return evaluation(long, y, "p", threshold, ("arm",))


def equal_alarms(grid: DataFrame, arms: dict[str, str], thresholds: list[float], events: DataFrame, spans: DataFrame, most: float) -> DataFrame:
    """Every arm at the least of the thresholds with at most `most` false alarms a day: what an input is worth at equal cost."""
    return alerts.operating_curves(grid, arms, thresholds, events, spans, most).where("chosen").select("arm", "threshold", "tpr", "false_per_day")


def _share(of: Column, where: Column) -> Column:
    return F.avg(F.when(where, of.cast("double")))


def onset_statistics(records: DataFrame, cls: str = "cls") -> DataFrame:
    """Per class: how hard the onset is against the peak and the background. Missing values are left out of each number."""
    on, top, bg = F.col("hardness_onset"), F.col("hardness_peak"), F.col("hardness_background")
    both = on.isNotNull() & top.isNotNull()
    medians = {"background": bg, "onset": F.when(both, on), "peak": F.when(both, top), "onset_over_peak": F.when(both & (top != 0), on / top), "onset_to_peak": F.col("onset_to_peak")}
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("n_with_onset"), _share(on >= 0.8 * top, both).alias("share_near_peak"), _share(F.coalesce(on > bg, F.lit(False)), both).alias("share_over_background")]
    return quantiles(records, [cls], {n: (c, 0.5) for n, c in medians.items()}, counts)


def neupert_statistics(records: DataFrame, least: float = 5.0) -> DataFrame:
    """Over records with a significant burst: how well the burst follows the slope, the quartiles of its lag, and how many."""
    rows = records.where(F.col("sigma") >= least)
    asked = {"r": (F.col("r"), 0.5)} | {f"lag_q{int(q * 100)}": (F.col("lag"), q) for q in (0.25, 0.5, 0.75)}
    return quantiles(rows, [], asked, [F.count(F.lit(1)).alias("n"), F.avg((F.col("r") > 0.5).cast("double")).alias("share_above_half")])


def repeated_runs(runs: DataFrame, gain: str = "gain", relative: str = "relative", low: str = "low") -> DataFrame:
    """One row on several runs of the same comparison: means, sample standard deviation, intervals above 0, and a verdict."""
    n, above = F.count(F.lit(1)), F.count(F.when(F.col(low) > 0, 1))
    verdict = F.when((above == n) & (n >= 3), "holds").when(F.count(F.when(F.col(gain) > 0, 1)) > n / 2, "mixed").otherwise("does not hold")
    return runs.agg(n.alias("runs"), F.avg(gain).alias("gain"), F.avg(relative).alias("relative"), F.when(n > 1, F.stddev_samp(relative)).alias("relative_sd"), above.alias("above_zero"), verdict.alias("verdict"))


def references(rows: DataFrame, y: str, forecasts: dict[str, str]) -> DataFrame:
    """Root mean square and bias of several forecasts on the rows where all of them and the truth are known."""
    every = rows.dropna(subset=[y, *forecasts.values()])
    one = lambda name, c: F.struct(F.lit(name).alias("forecast"), (F.col(c) - F.col(y)).cast("double").alias("e"))
    long = every.select(F.explode(F.array(*[one(n, c) for n, c in forecasts.items()])).alias("v")).select("v.*")
    return long.groupBy("forecast").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))


def calibration_report(rows: DataFrame, y: str, before: str, after: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score before and after calibration, and its skill over the base rate."""
    known = rows.where(F.col(y).isNotNull() & F.col(before).isNotNull() & F.col(after).isNotNull())
    score = lambda c: F.avg(F.pow(F.col(c) - F.col(y), F.lit(2)))
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), score(before).alias("before"), score(after).alias("after"), F.avg(F.col(y).cast("double")).alias("_base"))
    spread = F.col("_base") * (1 - F.col("_base"))
    return out.select(*by, "n", "before", "after", metrics.ratio(spread - F.col("after"), spread).alias("skill"))


def binned_medians(rows: DataFrame, x: str, y: str, width: float, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Median of y in bins of x with at least `least` rows, and its quartiles."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    asked = {f"q{int(q * 100)}": (F.col(y), q) for q in (0.25, 0.5, 0.75)}
    return quantiles(known.withColumn("bin", F.floor(F.col(x) / width)), [*by, "bin"], asked, [F.count(F.lit(1)).alias("n")]).where(F.col("n") >= least)


def weighted_mean(rows: DataFrame, value: str, error: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean weighted by the inverse square of the errors, its own error, and the number of values."""
    w = 1 / (F.col(error) * F.col(error))
    known = rows.where(F.col(value).isNotNull() & (F.col(error) > 0))
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.sqrt(1 / F.sum(w)).alias("error"))


def frozen(rows: DataFrame, thresholds: DataFrame, y: str, p: str, by: str) -> DataFrame:
    """Skill with thresholds fixed beforehand (`by`, threshold), a row for each of them that was used."""
    known = rows.join(F.broadcast(thresholds), by) if thresholds.limit(10_001).count() <= 10_000 else rows.join(thresholds, by)
    return metrics.contingency(known, F.col(y) == 1, F.col(p) >= F.col("threshold"), [by, "threshold"]).select(by, "threshold", "tp", "fp", "fn", "tn", "tss", "hss")
