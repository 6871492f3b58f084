"""Binary tables of FITS files (public standard, version 4.0) as rows, plain, gzip or inside zip archives.

Files are split among tasks by Spark's binaryFile source; a file is decoded where it lies. Scalar and fixed-length columns
of types L, B, I, J, K, E, D and A are read; TSCAL/TZERO are applied, TNULL and NaN become null. A file that can't be read
gives one row with its path and `error`.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types of a binary table: code to NumPy type (fixed by the standard).
_TYPES = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S1"}
_BLOCK = 2880


def _header(data: bytes, at: int) -> tuple[dict[str, object], int]:
    cards: dict[str, object] = {}
    while True:
        block = data[at : at + _BLOCK].decode("ascii", "replace")
        if len(block) < _BLOCK:
            raise ValueError("header without an end")
        at += _BLOCK
        for card in (block[i : i + 80] for i in range(0, _BLOCK, 80)):
            if card.startswith("END") and not card[3:].strip():
                return cards, at
            if card[8:10] != "= ":
                continue
            text = card[10:]
            if text.lstrip().startswith("'"):
                value: object = text.lstrip()[1:].split("'")[0].rstrip()
            else:
                raw = text.split("/")[0].strip()
                value = raw == "T" if raw in ("T", "F") else float(raw) if "." in raw or "E" in raw else int(raw) if raw else None
            cards[card[:8].strip()] = value


def tables(data: bytes) -> Iterator[tuple[dict[str, object], dict[str, np.ndarray]]]:
    """Header and columns of each binary table of a file."""
    if len(data) < _BLOCK:
        raise ValueError("shorter than a header")
    at = 0
    while at + _BLOCK <= len(data):
        h, at = _header(data, at)
        axes = [int(h[f"NAXIS{i + 1}"]) for i in range(int(h.get("NAXIS", 0)))]
        size = abs(int(h["BITPIX"])) // 8 * int(np.prod(axes)) + int(h.get("PCOUNT", 0)) if axes else 0
        if h.get("XTENSION") == "BINTABLE":
            fields = []
            for i in range(1, int(h["TFIELDS"]) + 1):
                form = str(h[f"TFORM{i}"]).strip()
                n = int(form[:-1] or 1)
                fields.append((str(h.get(f"TTYPE{i}", f"col{i}")), _TYPES[form[-1]], n, form[-1]))
            kind = np.dtype([(name, f"S{n}" if code == "A" else t, () if n == 1 or code == "A" else (n,)) for name, t, n, code in fields])
            rows = np.frombuffer(data, dtype=kind, count=axes[1], offset=at)
            columns = {}
            for i, (name, _, _, code) in enumerate(fields, 1):
                v = rows[name]
                if code == "A":
                    v = np.char.decode(v, "ascii", "replace")
                elif code != "L":
                    scale, zero = h.get(f"TSCAL{i}", 1), h.get(f"TZERO{i}", 0)
                    v = v * float(scale) + float(zero) if (scale, zero) != (1, 0) else v
                columns[name] = v
            yield h, columns
        at += -(-size // _BLOCK) * _BLOCK


def _members(path: str, content: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        import re

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if re.search(pattern, name):
                    yield f"{path}!{name}", z.read(name)
    else:
        yield path, content


def detectors(files: DataFrame, path: str = "path", pattern: str = r"(?i)(SDD[12])[^/]*\.(?:pi|lc)(?:\.gz)?$") -> DataFrame:
    """Files of a listing with the detector that their path names (null: none) and the folder they stand in: a product's files."""
    name = F.regexp_extract(path, pattern, 1)
    return files.select("*", F.when(name != "", F.upper(name)).alias("detector"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("product"))


def products(files: DataFrame, path: str = "path") -> DataFrame:
    """One row a product folder: its light curves and interval files in order of name, and the interval file of each curve."""
    named = detectors(files, path).withColumn("_gti", F.col(path).rlike(r"(?i)gti"))
    return named.groupBy("product").agg(
        F.sort_array(F.collect_set(F.when(~F.col("_gti"), F.col(path)))).alias("curves"), F.sort_array(F.collect_set(F.when(F.col("_gti"), F.col(path)))).alias("intervals"),
        F.sort_array(F.collect_set("detector")).alias("detectors"),
    )


def read(spark: SparkSession, path: str, extension: str, columns: dict[str, str], pattern: str = ".", header: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the binary table `extension` of each file: path, the header values `header` as text, `columns` (name: Spark type)
    and error."""
    kinds = ", ".join([f"path string, {''.join(f'{h} string, ' for h in header)}error string", *[f"`{c}` {t}" for c, t in columns.items()]])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for name, data in _members(where, content, pattern):
                        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                        for h, t in tables(data):
                            if str(h.get("EXTNAME", "")).strip() != extension:
                                continue
                            lower = {k.lower(): v for k, v in t.items()}
                            n = int(h["NAXIS2"])
                            out = {"path": [name] * n, **{k: [str(h.get(k, ""))] * n for k in header}, "error": [None] * n}
                            for c in columns:
                                v = lower.get(c.lower())
                                out[c] = [None] * n if v is None else v.astype(v.dtype.newbyteorder("=")).tolist() if v.dtype.kind in "iufb" else v.tolist()
                            yield pd.DataFrame(out)
                except (ValueError, KeyError, OSError, zipfile.BadZipFile) as e:
                    yield pd.DataFrame({"path": [where], **{k: [None] for k in header}, "error": [str(e)], **{c: [None] for c in columns}})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInPandas(decode, kinds)
    return rows.select("path", *header, "error", *[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in columns.items()])


def event_rows(counts: DataFrame, first: int = 41) -> DataFrame:
    """path, t, total of channels from `first` on: for checks against a light curve."""
    total = F.aggregate(F.slice("COUNTS", first + 1, 1 << 20), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return counts.select("path", F.col("TSTART").alias("t"), total.alias("total"))


def consistency(counts: DataFrame, curve: DataFrame, first: int = 41) -> DataFrame:
    """Greatest difference of summed channels from the light curve at equal times, whether exact, and n."""
    both = event_rows(counts, first).join(curve.select(F.col("TIME").alias("t"), F.col("COUNTS").alias("shipped")), "t")
    return both.agg(F.max(F.abs(F.col("total") - F.col("shipped"))).alias("most"), F.coalesce(F.max(F.abs(F.col("total") - F.col("shipped"))) == 0, F.lit(False)).alias("exact"), F.count(F.lit(1)).alias("n"))


def band_slots(rows: DataFrame, step: float, by: list[str]) -> DataFrame:
    """Long band rows (band, t, rate, err) on common slots of `step` seconds from the first time of each file's longest band (of
    equal ones the first by name); rows before it go. A slot was sampled if any band is non-zero; then zeros are genuine, else
    all are null."""
    each = rows.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_t0"))
    first = each.groupBy(*by).agg(F.min_by("_t0", F.struct(-F.col("_n"), F.col("band"))).alias("_t0"))
    slot = F.rint((F.col("t") - F.col("_t0")) / step).cast("long")
    placed = rows.join(first, by).withColumn("slot", slot).where("slot >= 0")
    live = placed.groupBy(*by, "slot").agg(F.bool_or((F.col("rate") != 0) | (F.col("err") != 0)).alias("live"))
    return placed.join(live, [*by, "slot"]).select(*by, "slot", "band", F.when(F.col("live"), F.col("rate")).alias("rate"), F.when(F.col("live"), F.col("err")).alias("err"), "live")
