"""Language identification by rank-order profiles.

A profile is the `TOP` most frequent character n-grams (one to three characters of lower-cased words, word ends marked) in
order of frequency. A language's profile comes from all labelled documents but the held-out ones: each task counts its
part by language, the counts are summed by language and n-gram, and the top of each language is kept. A document goes to
the language whose profile has the least out-of-place distance from its own; an n-gram that a profile lacks counts `TOP`.
The profiles of LABELS languages at a time are broadcast (TOP n-grams each); of more, documents pass one block of languages
after the other and keep the best.

Null text, or text without a letter: `und`, score 0. Ties go to the language first in code-point order. Null lang: not
learned from. Null doc_id: not held out. Without any labelled document all are `und`. Repeated rows count as often as they
stand. An empty table gives an empty result. Very long texts are counted whole, in parts cut between words. Columns other
than doc_id, text and lang are not read by the prediction; `accepted` carries all columns along as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, staged

TOP = 300
LABELS = 2_000
#: Documents that score less fit no learned language.
LEAST_SCORE = 0.1
_EDGE = 1  # stands for the end of a word
_PART = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers: 21 bits a character. Empty where it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _letters()[c]
    if not word.any():
        return np.zeros(0, dtype=np.int64)
    keep = word.copy()
    keep[1:] |= word[:-1]
    s = np.where(word, c, _EDGE)[keep].astype(np.int64)
    s = np.concatenate([[_EDGE] if s[0] != _EDGE else [], s, [_EDGE] if s[-1] != _EDGE else []]).astype(np.int64)
    two = s[:-1] << 21 | s[1:]
    three = (two[:-1] << 21 | s[2:])[s[1:-1] != _EDGE]
    return np.concatenate([s[s != _EDGE], two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text in order, and how often each stands in it; a long text is counted in parts."""
    if len(text) <= 4 * _PART:
        return np.unique(grams(text), return_counts=True)
    codes, numbers, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + _PART)
        while end < len(text) and text[end - 1].isalpha():  # parts end between words
            end += 1
        c, n = np.unique(grams(text[at:end]), return_counts=True)
        codes.append(c)
        numbers.append(n)
        at = end
    return _summed(codes, numbers)


def _summed(codes: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, back = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(back, weights=np.concatenate(numbers), minlength=len(c)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for x in batches:
        blocks: dict[str, list[str]] = {}
        for lang, text in zip(x["lang"].to_pylist(), x["text"].to_pylist(), strict=True):
            if len(text) > _PART:
                held.setdefault(lang, []).append(counted(text))
            else:
                blocks.setdefault(lang, []).append(text)
        for lang, texts in blocks.items():
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < _PART:
                    size += len(texts[to])
                    to += 1
                codes, distinct = pd.factorize(grams("\n".join(texts[at:to])))
                held.setdefault(lang, []).append((distinct, np.bincount(codes, minlength=len(distinct))))
                at = to
        for lang, parts in held.items():
            if len(parts) > 1:
                held[lang] = [_summed([c for c, _ in parts], [n for _, n in parts])]
    for lang, parts in held.items():
        for c, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def profiles(labelled: DataFrame, top: int = TOP) -> DataFrame:
    """lang, gram and rank (from 0) of each language's profile, from rows of text and lang."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < top).select("lang", "gram", "rank")


class Model:
    """Ranks of all n-grams of all profiles: gram by language, `top` where a profile lacks it."""

    def __init__(self, rows: pd.DataFrame, top: int = TOP):
        self.top, self.langs = top, sorted(rows["lang"].unique())
        self.codes = np.unique(rows["gram"].to_numpy(dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)  # the last row is for unknown ones
        column = {x: i for i, x in enumerate(self.langs)}
        self.ranks[np.searchsorted(self.codes, rows["gram"]), [column[x] for x in rows["lang"]]] = rows["rank"]

    def away(self, text: str | None) -> tuple[float, str] | None:
        """Least distance as a share of the greatest one, and its language; none without letters or languages."""
        codes, n = counted(text or "")
        if not len(codes) or not self.langs:
            return None
        own = codes[np.argsort(-n, kind="stable")[: self.top]]
        at = np.searchsorted(self.codes, own)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == own[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return float(away[best] / (self.top * len(own))), self.langs[best]


def learned(labelled: DataFrame, top: int = TOP, labels: int = LABELS) -> list[Model]:
    """The models of all labelled rows, a block of at most about `labels` languages each."""
    rows = labelled.where(F.col("lang").isNotNull())
    n = -(-rows.select("lang").distinct().count() // labels)
    if n <= 1:
        return [Model(profiles(rows, top).toPandas(), top)]
    every = staged(profiles(rows, top), "profiles")
    return [Model(every.where(F.pmod(F.xxhash64("lang"), F.lit(n)) == k).toPandas(), top) for k in range(n)]


def _predicted(models: list, texts: list[str | None]) -> list[tuple[str, float]]:
    out = []
    for t in texts:
        found = [x for m in models if (x := m.value.away(t)) is not None]
        out.append((min(found)[1], 1 - min(found)[0]) if found else ("und", 0.0))
    return out


def identified(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, from its text alone."""
    bounded_batches(docs.sparkSession)
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = _predicted(shared, x["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["held_out"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """`docs` without documents that fit no language learned from the others; a null lang becomes the prediction."""
    bounded_batches(docs.sparkSession)
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in learned(docs.where(~held_out()))]
    at_text, at_lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = _predicted(shared, x.column(at_text).to_pylist())
            langs = [old if old is not None else new for old, (new, _) in zip(x.column(at_lang).to_pylist(), got, strict=True)]
            fine = pa.array([lang != "und" and score >= least_score for lang, score in got], pa.bool_())
            columns = [pa.array(langs, x.column(i).type) if i == at_lang else x.column(i) for i in range(x.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=x.schema).filter(fine)

    return docs.mapInArrow(run, docs.schema)
