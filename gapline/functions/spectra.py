"""Spectra held as arrays: band rates and mean energies without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_energies(channels: int, breaks: tuple[tuple[int, float, float], ...]) -> list[float]:
    """Energy of each channel on a piecewise-linear scale: (first channel, energy there, energy a channel)."""
    out = []
    for c in range(channels):
        first, at, step = max(b for b in breaks if b[0] <= c)
        out.append(at + (c - first) * step)
    return out


def band_rate(counts: Column, energies: list[float], low: float, high: float, exposure: Column, first: int = 0) -> Column:
    """Counts of channels with low <= energy < high, from channel `first` on, a second of exposure; null without exposure."""
    inside = [i for i, e in enumerate(energies) if low <= e < high and i >= first]
    if not inside:
        return F.when(exposure > 0, F.lit(0.0))
    part = F.slice(counts, inside[0] + 1, len(inside))  # energies ascend, so a band is one slice
    return F.when(exposure > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / exposure)


def mean_energy(counts: Column, energies: list[float]) -> Column:
    """Counts-weighted mean energy; null where the counts sum to 0."""
    weights = F.array(*map(F.lit, energies))
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    moment = F.aggregate(F.zip_with(counts, weights, lambda c, e: c.cast("double") * e), F.lit(0.0), lambda s, x: s + x)
    return F.when(total != 0, moment / total)


def fine(counts: Column, exposure: Column) -> Column:
    """Validity: every channel finite, exposure positive."""
    return F.coalesce(F.forall(counts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (exposure > 0), F.lit(False))
