"""Removal of bytes in strings of 400 bytes that start anywhere else, by bucket refinement over anchored suffixes.

A full suffix array over a corpus would deal out a row for each byte. Here the suffixes that take part are thinned without
loss: each possible start of a string has an anchor, the place of the least q-gram hash within the string, so equal strings
have their anchor at the same offset. The starts of one anchor form a cell, a range of offsets before the anchor.

Buckets are then refined in the manner of bucket-pointer refinement. The initial buckets are those of the anchors' q-grams.
The identifier of a bucket of longer stretches is the hash of a stretch, taken from prefix sums of the text in each of the
three rounds, where the method proper puts it together from the ranks of later offsets: a hash needs no global sort of
suffixes. Only buckets with several members are refined further. For an open cell two
identifiers are compared: that of the stretch which all its strings share (the core: alone in its bucket, none of the
strings repeats) and that of the stretch which covers them all (the cover: in company, all of them repeat). Where a core
has several covers, one cell of each cover is split, from the anchor's whole range to 16 offsets to single ones, where
core, cover and string are the same.

Counting a bucket needs no list of its members: its first member and whether it is alone are known from the least reference
and a count, and every other one is in company. So buckets of any size are pre-aggregated before the shuffle, and no pairs
are made.

`removals` gives what is left of each document and the spans that went, `without_repeats` their digests. A passage shorter
than 400 bytes stays, however many words it has. Null text is empty. Rows are told apart by id and text; rows equal in both
are copies of each other, and are counted as such. Texts under 400 bytes lose nothing. Very long texts are handled whole, in
parts that overlap by a string; of equal q-gram hashes the leftmost is the anchor. An empty table gives an empty result.
Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .hashes import SECOND, Stretches
from .words import window_least

LENGTH, GRAM = 400, 100
FAN = 16
ALONE, COMPANY, CLOSED = 0, 1, 2
#: Bytes of a text handled at once; parts overlap by a string.
PART = 1 << 22
_ITEMS = "core long, cover long, cover2 long, cell int, k long, th long, p long, low int, high int"


def cells(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors p in order, the least and greatest offset (p - start) of the strings that each one anchors, and its q-gram's identifier."""
    out, at = [], 0
    while at + LENGTH <= len(buf):
        part = buf[at : at + PART + LENGTH - 1]
        at_gram = np.arange(len(part) - GRAM + 1)
        h = Stretches(part).of(at_gram, at_gram + GRAM)
        # 40 bits of the hash, then the place, so that the leftmost of equal ones is the least
        ranked = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        p = (window_least(ranked, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(p) - 1]])
        out.append((p[first] + at, p[first] - last, p[first] - first, h[p[first]].view(np.int64)))
        at += PART
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text(x) -> np.ndarray:
    return np.frombuffer((x or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor with the bucket of its q-gram."""
    names = ["core", "k", "th", "p"]
    for x in batches:
        held, size = [], 0
        for k, th, text in zip(x["k"].to_pylist(), x["th"].to_pylist(), x["text"].to_pylist(), strict=True):
            p, _, _, gram = cells(_text(text))
            if len(p):
                held.append((gram, np.full(len(p), k), np.full(len(p), th), p))
                size += len(p)
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


_OPEN = "doc_id long, k long, th long, text string, n_bytes long, rest string, p array<long>, low array<int>, high array<int>"


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind) if parts else pa.array([], kind))


def _parts(column: pa.ListArray) -> list[np.ndarray]:
    """Each list of a column as an array; null is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(column.flatten().to_numpy(), np.cumsum(lengths)[:-1]) if len(lengths) else []


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the cells of anchors whose q-gram is not alone; without any, the whole text as what is left."""
    for x in batches:
        opened, n_bytes, ps, lows, highs = [], [], [], [], []
        for t, alone in zip(x["text"].to_pylist(), _parts(x["alone"]), strict=True):
            buf = _text(t)
            p, low, high, _ = cells(buf)
            keep = ~np.isin(p, alone)
            opened.append(bool(keep.any()))
            n_bytes.append(len(buf))
            ps.append(p[keep])
            lows.append(low[keep])
            highs.append(high[keep])
        lists = [_lists(ps, pa.int64()), _lists([v.astype(np.int32) for v in lows], pa.int32()), _lists([v.astype(np.int32) for v in highs], pa.int32())]
        opened, none = pa.array(opened, pa.bool_()), pa.scalar(None, x["text"].type)
        text, rest = pc.if_else(opened, x["text"], none), pc.if_else(opened, none, x["text"])
        yield pa.RecordBatch.from_arrays([x["doc_id"], x["k"], x["th"], text, pa.array(n_bytes, pa.int64()), rest, *lists], names=[f.split()[0] for f in _OPEN.split(", ")])


def split(p: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells cut at multiples of `width`."""
    n = high // width - low // width + 1
    at = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + (low // width)[at]
    return p[at], np.maximum(low[at], j * width), np.minimum(high[at], (j + 1) * width - 1)


def _refined(width: int):
    """The identifiers of all open cells. `width` of a cell: 0 stands for an anchor's whole range."""

    names = [f.split()[0] for f in _ITEMS.split(", ")]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held, size = [], 0
            for k, th, text, p, low, high in zip(*(x[c].to_pylist() for c in ("k", "th", "text")), *(_parts(x[c]) for c in ("p", "low", "high")), strict=True):
                if not len(p):
                    continue
                buf, low, high = _text(text), low.astype(np.int64), high.astype(np.int64)
                h, other = Stretches(buf), Stretches(buf, SECOND)
                # the core is that of the full cell, whatever part of it this anchor has
                lo, hi = (low // width * width, low // width * width + width - 1) if width else (low, high)
                core = h.of(p - lo, p - np.minimum(hi, LENGTH - GRAM) + LENGTH) if width else h.of(p, p + GRAM)
                a, b = p - high, p - low + LENGTH
                cell = lo // width if width else np.zeros(len(p), dtype=np.int64)
                n = len(p)
                held.append((core.view(np.int64), h.of(a, b).view(np.int64), other.of(a, b).view(np.int64), cell.astype(np.int32), np.full(n, k), np.full(n, th), p, low.astype(np.int32), high.astype(np.int32)))
                size += n
                if size > 100_000:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    return run


def _next(width: int):
    """Cells after a round: those in company are marked; one of each bucket goes on, split, unless its core has no other."""
    names = ["k", "th", "marked", "p", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = [[] for _ in names[2:]]
            for p, low, high, first in zip(*(_parts(x[c]) for c in ("p", "low", "high", "first")), strict=True):
                low, high = low.astype(np.int64), high.astype(np.int64)
                name, what = p * 1024 + high, first & 3
                alone, company, closed = (np.isin(name, first[what == c] >> 2) for c in (ALONE, COMPANY, CLOSED))
                marked = np.stack([p - high, p - low], axis=1)[~alone]
                still = (alone | company) & ~closed
                q = split(p[still], low[still], high[still], width) if width else (p[:0], low[:0], high[:0])
                for c, v in zip(out, (marked.ravel(), *q), strict=True):
                    c.append(v)
            lists = [_lists(out[0], pa.int64()), _lists(out[1], pa.int64()), *(_lists([v.astype(np.int32) for v in c], pa.int32()) for c in out[2:])]
            yield pa.RecordBatch.from_arrays([x["k"], x["th"], *lists], names=names)

    return run


_LEFT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document without the strings that start in the marked ranges, and the runs that went."""
    for x in batches:
        n_bytes, starts, ends, kept = [], [], [], []
        for text, marked in zip(x["text"].to_pylist(), x["marked"].to_pylist(), strict=True):
            buf = _text(text)
            edge = np.zeros(len(buf) + 1, dtype=np.int64)
            m = np.array(marked or [], dtype=np.int64).reshape(-1, 2)
            np.add.at(edge, m[:, 0], 1)
            np.add.at(edge, m[:, 1] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turns = np.diff(gone.astype(np.int8), prepend=0, append=0)
            n_bytes.append(len(buf))
            starts.append(np.flatnonzero(turns == 1))
            ends.append(np.flatnonzero(turns == -1))
            kept.append(buf[~gone].tobytes())
        first, last = _lists(starts, pa.int64()), _lists(ends, pa.int64())
        spans = pa.ListArray.from_arrays(first.offsets, pa.StructArray.from_arrays([first.values, last.values], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(n_bytes, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _firsts(items: DataFrame) -> DataFrame:
    """The first cell of each cover's bucket, alone or in company, and those whose core has no other cover (closed), by document."""
    me = F.struct("k", "th", "p", "low", "high")
    covers = items.groupBy("core", "cell", "cover", "cover2").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("me"))
    cores = covers.groupBy("core", "cell").agg(F.count(F.lit(1)).alias("covers"), F.min("me").alias("me"))
    both = covers.select("me", F.when(F.col("n") == 1, ALONE).otherwise(COMPANY).alias("what")).union(cores.where("covers = 1").select("me", F.lit(CLOSED).alias("what")))
    named = (F.col("me.p") * 1024 + F.col("me.high")) * 4 + F.col("what")
    return both.groupBy("me.k", "me.th").agg(F.collect_list(named).alias("first"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed runs of bytes (`spans`, in order, end exclusive) and what is left (`kept`) of each document.

    What is left are bytes: a string may begin or end within a character.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
    anchors = rows.where(F.length("text") * 4 >= LENGTH).select("k", "th", "text").mapInArrow(_anchors, "core long, k long, th long, p long")
    grams = anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "th", "p")).alias("me")).where("n = 1")
    alone = grams.groupBy("me.k", "me.th").agg(F.collect_list("me.p").alias("alone"))
    state = staged(rows.join(alone, ["k", "th"], "left").select("doc_id", "k", "th", "text", "alone").mapInArrow(_opened, _OPEN), "open")
    untouched = state.where(F.col("text").isNull()).select("doc_id", "n_bytes", F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.col("rest").cast("binary").alias("kept"))
    touched = state.where(F.col("text").isNotNull())
    texts = touched.select("doc_id", "k", "th", "text")
    now, marks = touched.select("k", "th", "p", "low", "high"), None
    for width, next_width in ((0, FAN), (FAN, 1), (1, 0)):
        at = (touched if not width else texts.join(now.where(F.size("p") > 0).dropDuplicates(["k", "th"]), ["k", "th"])).select("k", "th", "text", "p", "low", "high")
        items = at.mapInArrow(_refined(width), _ITEMS)
        judged = now.dropDuplicates(["k", "th"]).join(_firsts(items), ["k", "th"], "left").select("k", "th", "p", "low", "high", "first")
        after = staged(judged.mapInArrow(_next(next_width), "k long, th long, marked array<long>, p array<long>, low array<int>, high array<int>"), f"round{width}")
        found = after.where(F.size("marked") > 0).select("k", "th", "marked")
        marks = found if marks is None else marks.union(found)
        now = after.select("k", "th", "p", "low", "high")
    gathered = marks.groupBy("k", "th").agg(F.flatten(F.collect_list("marked")).alias("marked"))
    done = texts.join(gathered, ["k", "th"], "left").select("doc_id", "text", "marked").mapInArrow(_removed, _LEFT)
    return done.union(untouched)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, its spans (start:end, comma-joined) and whether it has any (`repeated`)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return removals(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), joined.alias("spans"), (F.size("spans") > 0).alias("repeated"))
