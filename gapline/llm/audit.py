"""What each filter of a chain removes, in every order of the filters, from one histogram of failures.

A document fails a subset of the n filters, which is a mask of n bits. All that an order of the filters does to a part of the
corpus follows from the histogram of the masks in it: stack the histograms of all parts as rows (all documents, those with a
good label, those with a toxic label) and multiply by whole-number matrices of 2^n rows and n! * n columns, one for each
outcome (kept, removed, redundant, unique), a column for each order and step. Texts are read once, whatever the number of
orders.

Null text is empty, null parts are the empty string. Of copies of a text all but those with the least id fail the filter for
copies; rows that share the least id do not, and rows without an id neither fail it nor make others fail. Repeated rows count
each. A document has a label if any row of the labels gives it; labels of no document count nowhere. An empty table gives an
empty result. Very long texts are split in parts of some megabytes for their words. Columns other than those named are not
read, so none can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches

FILTERS = "ABCDE"
#: The filters that look at one text, in the order of their bits; the one for copies comes last.
SHORT, REPETITIVE, CAPITALS, SYMBOLS, COPY = (1 << i for i in range(5))
#: Bytes of a text whose words are held at once.
PART = 4 << 20

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SPACES = b" \t\n\r\x0b\x0c"


def _words(data: bytes) -> tuple[int, int]:
    """The number of words and of distinct words."""
    if len(data) <= PART:
        words = data.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        words = data[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(text: str) -> int:
    """The mask of the filters that look at one text."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = _words(data)
    mask = SHORT * (n < 200) + REPETITIVE * (100 * distinct < 50 * n)
    mask += CAPITALS * (100 * len(data.translate(None, _NOT_UPPER)) > 3 * len(text))
    return mask + SYMBOLS * any(c in text for c in "#$%&*|")


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        masks, keys = [], []
        for text in x["text"]:
            text = text.as_py() or ""
            masks.append(failed(text))
            keys.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays([x["doc_id"], x["part"], pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "mask", "copy"])


def failures(docs: DataFrame, part: Column | None = None) -> DataFrame:
    """doc_id, part, mask (of the filters on one text) and copy (a key of the text) of each document."""
    bounded_batches(docs.sparkSession)
    part = F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(_failures, "doc_id long, part string, mask int, copy binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with good and toxic, false where no label says so."""
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(says, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def histograms(rows: DataFrame, copies: int = COPY) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each mask, with the bit `copies` for all copies but the first.

    `rows` has doc_id, part, mask, copy, good and toxic. Copies of a text are summed up before they meet, so a text that
    stands in a third of all rows is one row a task; what meets under one text is a row for each part, mask and label.
    """
    kinds = ["copy", "part", "mask", "good", "toxic"]
    one = rows.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("_n"))
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_n"))
    sums = one.groupBy(*kinds).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("_n")).otherwise(0)).alias("_free"), F.min(first).alias("_first"))
    least = F.min("_first.doc_id").over(W.partitionBy("copy"))
    spared = F.col("_free") + F.when(F.col("_first.doc_id") == least, F.col("_first._n")).otherwise(0)
    split = sums.withColumn("_spared", spared).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("mask"), F.col("_spared").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), (F.col("n") - F.col("_spared")).alias("n")))).alias("_x"),
    )
    n = F.col("_x.n")
    return split.groupBy("part", F.col("_x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


@lru_cache(maxsize=8)
def outcomes(n: int) -> dict[str, np.ndarray]:
    """0/1 matrices of 2^n masks by n! * n (order, step) for kept, removed, redundant and unique, and the filter of each column."""
    orders = np.array(list(permutations(range(n))), dtype=np.int64)
    bit = 1 << orders
    upto = np.cumsum(bit, axis=1)
    masks = np.arange(1 << n)[:, None, None]
    here, before = (masks & bit) > 0, (masks & (upto - bit)) > 0
    found = {"kept": (masks & upto) == 0, "removed": here & ~before, "redundant": here & before, "unique_fails": np.broadcast_to(masks == bit, here.shape)}
    return {k: v.reshape(1 << n, -1).astype(np.int64) for k, v in found.items()} | {"filter": orders.ravel()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(histogram: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of each part, order of `filters` and step, as in COUNTS: a row of `histogram` for each part and mask.

    kept: after this step; removed: here; redundant: failing its filter, but removed earlier; unique_fails: failing its filter
    only; good_lost and toxic_lost: removed here with that label; shapley: what the step's filter removes, summed over all
    orders. Every part of the histogram gets all rows, zeros included.
    """
    n = len(filters)
    names = ["".join(p) for p in permutations(filters)]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = outcomes(n)
        for x in batches:
            for part, cells in zip(x["part"], x["cells"], strict=True):
                rows = np.zeros((3, 1 << n), dtype=np.int64)
                for c in cells:
                    rows[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                every, good, toxic = rows
                removed = rows @ m["removed"]
                by_filter = np.zeros(n, dtype=np.int64)
                np.add.at(by_filter, m["filter"], removed[0])
                counts = (every @ m["kept"], removed[0], every @ m["redundant"], every @ m["unique_fails"], removed[1], removed[2], by_filter[m["filter"]])
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), math.factorial(n))} | dict(zip(COUNTS, counts, strict=True)))

    stacked = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a part has 2^n masks at most
    return stacked.mapInPandas(products, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over `docs` by lang."""
    return audit(histograms(labelled(failures(docs), labels)))
