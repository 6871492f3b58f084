"""Per-event numbers: spectra, lags, peak intervals; and the fits that need a search, one event a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, spans


def energy_edges(low: float, high: float, bins: int) -> list[float]:
    """Geometric bin edges."""
    return [low * (high / low) ** (i / bins) for i in range(bins + 1)]


def histogram(df: DataFrame, energy: str, edges: list[float], by: list[str]) -> DataFrame:
    """Counts per bin [edge, next edge), the last bin closed; empty bins have no row."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        upto = F.col(energy) <= edges[i + 1] if i == len(edges) - 2 else F.col(energy) < edges[i + 1]
        b = F.when((F.col(energy) >= edges[i]) & upto, F.lit(i)).otherwise(b)
    return df.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def tick_counts(df: DataFrame, tick: Column, by: str = "series") -> DataFrame:
    """Counts per tick on a dense grid, 0 where nothing came."""
    from .grid import spine

    counts = df.groupBy(by, tick.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return spine(counts, by=by).fillna(0, ["n"])


def lagged_correlation(df: DataFrame, x: str, y: str, most: int, least: int = 5, k: str = "k", by: str = "series") -> DataFrame:
    """The lag in [-most, most] with the greatest correlation of x(k) with y(k + lag) (ties to the least lag), and that r.

    Lags with fewer than `least` pairs or a constant side don't count; a series without any has no row."""
    a = df.where(F.col(x).isNotNull()).select(by, F.col(k).alias("_k"), F.col(x).alias("_x")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    b = df.where(F.col(y).isNotNull()).select(by, F.col(k).alias("_k2"), F.col(y).alias("_y"))
    both = a.withColumn("_k2", F.col("_k") + F.col("lag")).join(b, [by, "_k2"])
    r = both.groupBy(by, "lag").agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    top = r.groupBy(by).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round("r", 12), -F.col("lag"))).alias("b"))
    return top.select(by, "b.lag", "b.r", "b.n")


def lag_covariance(df: DataFrame, lags: list[int], x: str = "n", k: str = "k", by: str = "series") -> DataFrame:
    """Per series and lag the covariance of the counts of steps `lag` apart, over pairs of steps that are both there, its ratio
    to the mean count (what counting alone would give at lag 0), and the number of pairs."""
    left = df.select(by, k, F.col(x).cast("double").alias("_a")).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    right = df.select(by, (F.col(k)).alias("_k2"), F.col(x).cast("double").alias("_b"))
    both = left.withColumn("_k2", F.col(k) + F.col("lag")).join(right, [by, "_k2"])
    out = both.groupBy(by, "lag").agg(F.count(F.lit(1)).alias("pairs"), F.covar_pop("_a", "_b").alias("covariance"), F.avg("_a").alias("_m"))
    return out.select(by, "lag", "pairs", "covariance", F.when(F.col("_m") > 0, F.col("covariance") / F.col("_m")).alias("over_mean"))


def occupancy(ticks: DataFrame, per: int, x: str = "n", k: str = "k", by: str = "series") -> DataFrame:
    """Per `per` ticks the share of ticks with a count and the counts: where the share is low, dead ticks spoil the timing."""
    return ticks.groupBy(by, F.floor(F.col(k) / per).alias("second")).agg((F.count(F.when(F.col(x) > 0, 1)) / per).alias("share"), F.sum(x).alias("counts"))


def refined_lag(df: DataFrame, by: str = "series") -> DataFrame:
    """Per series the vertex of the parabola through the best lag and its neighbours; `df` has lag and r of all lags."""
    best = df.groupBy(by).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("_l"))
    at = df.join(best, by).where(F.abs(F.col("lag") - F.col("_l")) <= 1)
    r = lambda d: F.max(F.when(F.col("lag") == F.col("_l") + d, F.col("r")))
    three = at.groupBy(by, "_l").agg(r(-1).alias("a"), r(0).alias("b"), r(1).alias("c"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    return three.select(by, (F.col("_l") + F.when(bend < 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)).alias("lag"))


def peak_interval(df: DataFrame, steps: int, x: str = "n", k: str = "k", by: str = "series") -> DataFrame:
    """start of the `steps` consecutive steps with the greatest sum (ties to the earliest) and the sum; whole stretches only."""

    def columns(w):
        f = w.rangeBetween(0, steps - 1)
        return {"_s": F.when(F.count(F.lit(1)).over(f) == steps, F.sum(x).over(f))}

    sums = frames.framed(df, k, 0, steps, columns, by).where(F.col("_s").isNotNull())
    return sums.groupBy(by).agg(F.max_by(k, F.struct("_s", -F.col(k))).alias("start"), F.max("_s").alias("total"))


def fit_range(bins: DataFrame, least: float = 3.0, by: str = "series") -> DataFrame:
    """Bins from the first one up to the first whose n falls below `least` standard deviations over the background."""
    ok = (F.col("n") - F.col("bkg")) >= least * F.sqrt(F.greatest(F.col("bkg"), F.lit(1.0)))
    first = bins.groupBy(by).agg(F.min(F.when(~ok, F.col("bin"))).alias("_f"))
    return bins.join(first, by).where(F.col("_f").isNull() | (F.col("bin") < F.col("_f"))).drop("_f")


def line_centroid(spectrum: DataFrame, low: float, high: float, by: str = "series") -> DataFrame:
    """Centroid of the counts between two energies over the median of that range; null without an excess."""
    rows = spectrum.where(F.col("energy").between(low, high))
    base = rows.groupBy(by).agg(F.percentile("counts", F.lit(0.5)).alias("_m"))
    over = F.greatest(F.col("counts") - F.col("_m"), F.lit(0.0))
    out = rows.join(base, by).groupBy(by).agg(F.sum(over * F.col("energy")).alias("_e"), F.sum(over).alias("_n"))
    return out.select(by, F.when(F.col("_n") > 0, F.col("_e") / F.col("_n")).alias("centroid"), F.col("_n").alias("excess"))


def _amplitude(shape: np.ndarray, background: np.ndarray, n: np.ndarray) -> float:
    """The amplitude of greatest Poisson likelihood of n = background + A * shape; a closed form without background."""
    total = float(shape.sum())
    if not background.any():
        return float(n.sum()) / total
    high = max(float(n.sum()) / total, 1e-12)
    low = high * 1e-12
    for _ in range(100):  # the derivative falls in A
        mid = (low * high) ** 0.5
        low, high = (mid, high) if (n * shape / (background + mid * shape)).sum() > total else (low, mid)
    return (low * high) ** 0.5


def _searched(loss, a: float, z: float) -> float:
    """Golden section of a function with one valley."""
    r = (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = z - r * (z - a), a + r * (z - a)
        a, z = (a, d) if loss(c) < loss(d) else (c, z)
    return (a + z) / 2


def _fitted(bins: DataFrame, name: str, by: str, shape, low: float, high: float, log: bool) -> DataFrame:
    """One-parameter Poisson fits per group, amplitude profiled out; the error is the half width where the likelihood falls by 1/2,
    from its curvature."""
    kind = dict(bins.dtypes)[by]
    extra = [c for c in ("bkg", "eff") if c in bins.columns]

    def fit(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("bin_lo")
        lo, hi, n = (t[c].to_numpy(dtype=float) for c in ("bin_lo", "bin_hi", "n"))
        b = t["bkg"].to_numpy(dtype=float) if "bkg" in extra else np.zeros(len(n))
        e = t["eff"].to_numpy(dtype=float) if "eff" in extra else np.ones(len(n))
        net = float((n - b).sum())

        def loss(v):
            s = np.maximum(shape(np.exp(v) if log else v, lo, hi) * e, 1e-300)
            m = np.maximum(b + _amplitude(s, b, n) * s, 1e-300)
            return float((m - n * np.log(m)).sum())

        if len(n) < 3 or net <= 0:
            return pd.DataFrame({by: [key[0]], name: [None], "error": [None], "n": [float(n.sum())], "net": [net]})
        v = _searched(loss, np.log(low) if log else low, np.log(high) if log else high)
        h = 1e-3
        bend = (loss(v + h) - 2 * loss(v) + loss(v - h)) / h**2
        value = float(np.exp(v)) if log else float(v)
        return pd.DataFrame({by: [key[0]], name: [value], "error": [bend**-0.5 * (value if log else 1.0) if bend > 0 else None], "n": [float(n.sum())], "net": [net]})

    return bins.groupBy(by).applyInPandas(fit, f"{by} {kind}, {name} double, error double, n double, net double")


def power_law(bins: DataFrame, by: str = "series", low: float = 1.01, high: float = 12.0) -> DataFrame:
    """Poisson likelihood fit of counts = background + A * integral of E^-index per bin: index, error, n and net counts.

    `bins` has bin_lo, bin_hi, n and, where there is a background, its scaled counts `bkg`; all bins of a group are given, empty
    ones included. Fewer than 3 bins, or no net counts: null.
    """
    return _fitted(bins, "index", by, lambda g, lo, hi: (hi ** (1 - g) - lo ** (1 - g)) / (1 - g), low, high, False)


def temperature(bins: DataFrame, by: str = "series", low: float = 2.0, high: float = 60.0, slope: float = 1.0) -> DataFrame:
    """Poisson fit of background + A * E^-slope * exp(-E / kT) * efficiency per bin at its middle: kT (unit of E), error, n, net.

    `bins` as for power_law, with an efficiency `eff` for each bin where the detector has one.
    """
    return _fitted(bins, "kt", by, lambda kt, lo, hi: ((lo + hi) / 2) ** -slope * np.exp(-(lo + hi) / 2 / kt) * (hi - lo), low, high, True)


def silicon_efficiency(e, thickness_um: float = 450.0):
    """Share of photons of energy e (keV) that silicon of that thickness stops."""
    return 1 - F.exp(-33.9 * F.pow(e / 10.0, F.lit(-2.9)) * 2.33 * thickness_um * 1e-4)


def adaptive_bins(counts: DataFrame, least: float = 300.0, shortest: int = 4, grow: int = 2, by: str = "event", k: str = "k") -> DataFrame:
    """Greedy time bins along each event: at least `shortest` steps, growing by `grow` until the net counts reach `least`; what
    is left at the end without enough is dropped. start, stop (exclusive), net. An event is one group."""

    def walk(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(k)
        steps, net = t[k].to_numpy(), t["net"].to_numpy()
        out, i = [], 0
        while i + shortest <= len(net):
            j = i + shortest
            while j < len(net) and net[i:j].sum() < least:
                j = min(j + grow, len(net))
            if net[i:j].sum() < least:
                break
            out.append((key[0], int(steps[i]), int(steps[j - 1]) + 1, float(net[i:j].sum())))
            i = j
        return pd.DataFrame(out, columns=[by, "start", "stop", "net"])

    kind = dict(counts.dtypes)[by]
    return counts.groupBy(by).applyInPandas(walk, f"{by} {kind}, start long, stop long, net double")


def flare_record(events: DataFrame, samples: DataFrame, before: int, after: int, decision: int, x: str = "x", t: str = "t", by: str = "series") -> DataFrame:
    """Per event (by, event, start): samples in [start - before, start + after], median of those before the start, greatest value and
    how long after the start its first place is, rise, and the greatest value known at start + decision (later samples never
    enter a decision-time column). Every sample counts by itself; nulls are left out."""

    def measure(ts, xs, at):
        a, z = spans.bounds(ts, at - before, at + after)
        pre, known = spans.bounds(ts, at - before, at - 1), spans.bounds(ts, at - before, at + decision)
        order = np.lexsort((-ts, xs))  # of equal values the earliest is the last one
        rank = np.empty(len(xs), dtype=np.int64)
        rank[order] = np.arange(len(xs))
        best = spans.extremes(rank, a, z)
        first = order[best.filled(0)] if len(xs) else np.zeros(len(at), dtype=np.int64)
        value, time = (np.ma.masked_array(c[first] if len(xs) else np.zeros(len(at)), best.mask) for c in (xs, ts))
        return {"n": z - a, "background": spans.Ranks(xs).quantile(*pre, 0.5), "top": value, "top_at": time - at, "top_known": spans.extremes(xs, *known)}

    out = spans.around(events, samples, measure, "n long, background double, top double, top_at long, top_known double", before, after, x, t, by, 2 * (before + after + 1))
    return out.withColumn("rise", F.when(F.col("background") > 0, F.col("top") / F.col("background")))
