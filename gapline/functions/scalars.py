"""Missing values, safe ratios, class strings, hardness, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of flux classes with the flux of their magnitude 1.
CLASSES = (("A", 1e-8), ("B", 1e-7), ("C", 1e-6), ("M", 1e-5), ("X", 1e-4))


def known(x: Column) -> Column:
    """NaN is a missing value: null."""
    return F.when(~F.isnan(x), x)


def safe_ratio(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return a / (b + eps)


def log1p_floor(x: Column) -> Column:
    """log(1 + x) with negatives as 0; null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def log10_floor(x: Column, least: float = 1e-9) -> Column:
    return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(least))))


def class_flux(text: Column) -> Column:
    """Flux of the class a text starts with, such as M2.5 or M2.5/1N; a bare letter is magnitude 1; null where it is none."""
    pattern = r"^\s*([ABCMXabcmx])\s*([0-9.]+)?"
    letter, size = F.upper(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    scale = F.coalesce(*[F.when(letter == c, F.lit(f)) for c, f in CLASSES])
    return scale * F.when(size == "", F.lit(1.0)).otherwise(size.try_cast("double"))


def flux_class(flux: Column) -> Column:
    """Class of a flux, one decimal: 9.97e-7 is C1.0, 1.2e-3 X12.0; below A or missing: empty."""
    out = F.lit("")
    for i, (c, f) in enumerate(CLASSES):
        size = F.bround(flux / f, 1)
        bound = F.lit(True) if i == len(CLASSES) - 1 else size < 10.0
        lowest = flux >= f if i == 0 else size >= 1.0
        out = F.when(lowest & bound & (out == ""), F.concat(F.lit(c), F.format_string("%.1f", size))).otherwise(out)
    return F.when(flux.isNull() | F.isnan(flux) | (flux < CLASSES[0][1]), F.lit("")).otherwise(out)


def hardness(high: list[Column], low: list[Column], least: float = 1.0) -> Column:
    """Sum over sum; null where the lower band has less than `least` or a part is missing."""
    h, lo = reduce(lambda a, b: a + b, high), reduce(lambda a, b: a + b, low)
    return F.when(lo >= least, h / lo)


def version_priority(text: Column) -> Column:
    """V212 is 212.0; null or without a number: 0."""
    return F.coalesce(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0))


def version_parts(text: Column) -> Column:
    """v1.10 as [1, 10], which compares part by part."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda p: p.cast("int"))
