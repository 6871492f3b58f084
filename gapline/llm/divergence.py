"""How the sources of a language differ in their terms, by sort-based streaming.

First scan: documents give rows of (lang, term, source, document), summed up within blocks of documents on the side that reads
them (a block's row stands under its first document and says how many documents it is of). They are dealt by (lang, term) and
sorted within by term, lang, source and document (the term first: a sort compares a prefix of its first column); a run-length
scan gives each term its document frequency and its counts by source, and keeps the terms in enough documents. What is carried over a batch's end is one row a source, so a term of any frequency
takes no memory.

Second scan: the kept terms, with the smoothed shares p of each source that has them, in the same order. Each run of a term
emits its terms (p above the language's) and adds to the partial differences of the pairs of sources that share it. A pair's
sum over all kept terms follows: for sources a and b with shares a0 and b0 of a term they lack, every term of a that b lacks
gives |p - b0|. So per source only the histogram of its p is needed beside the shared terms, and no row is made for a term
that a source lacks.

Null text, lang and source are the empty string. Rows are documents: repeated rows and null ids count each. Terms are cut out
of whole texts of any length (a text beyond some megabytes in parts cut where no term is); of equal values the term or source
of the lesser UTF-8 bytes ranks first. An empty table gives an empty result. Columns other than text, lang and source are not
read, so none can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, staged

#: Documents a kept term is in at least, what is added to each count, and the unit of shares.
LEAST, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Rows that a block holds before they are emitted, bytes of a text at once, pairs of sources summed up at once.
ROWS, PART, PAIRS = 400_000, 4 << 20, 1_000_000

_IS_TERM = [chr(b).isalpha() if b < 128 else True for b in range(256)]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_TERM[b] else 32 for b in range(256))


def _parts(data: bytes, most: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and data[end] != 32:
            end += 1
        yield data[at:end]
        at = end


def terms(text: str) -> tuple[list[bytes], set[bytes]]:
    """The terms of a text in order and its distinct ones, A-Z lower-cased."""
    found = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    distinct = set(found)
    distinct.discard(b"")
    return found, distinct


def _occurrences(block_rows: int, most: int):
    """Rows of (lang, term, source, document) with the documents and occurrences of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, document, first = TaskContext.get().partitionId(), 0, 0
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def block() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                counts.pop(b"", None)
                names = list(counts)
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    n = len(part)
                    cols = [pa.array([lang] * n), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * n), pa.array(np.full(n, (task << 40) + first)), pa.array([docs[t] for t in part], pa.int64()), pa.array([counts[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "term", "source", "document", "docs", "count"])

        for x in batches:
            for lang, source, text in zip(x["lang"].to_pylist(), x["source"].to_pylist(), x["text"], strict=True):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                data = text.as_py()
                if len(data) <= most:
                    found, distinct = terms(data)
                    counts.update(found)
                else:
                    distinct = set()
                    for part in _parts(data.encode("utf-8", "surrogatepass").translate(_TABLE), most):
                        found = part.split(b" ")
                        counts.update(found)
                        distinct.update(found)
                    distinct.discard(b"")
                docs.update(distinct)
                document += 1
            if sum(len(c) for c, _ in held.values()) >= block_rows:
                yield from block()
                held, first = {}, document
        yield from block()

    return run


def _starts(*columns: pa.Array) -> np.ndarray:
    """Places where one of the columns differs from the row before."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
    return np.flatnonzero(new)


def _kept(least: int):
    """Run-length scan: a row for each term of a language in at least so many documents, its sources and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def rows(lang, term, source, docs, count, at, to):
            """The runs that begin at `at` and end at `to`."""
            total = np.concatenate([[0], np.cumsum(docs)])
            good = total[to] - total[at] >= least
            at, to = at[good], to[good]
            where = np.concatenate([np.arange(a, b) for a, b in zip(at, to, strict=True)]) if len(at) else np.zeros(0, dtype=np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(to - at)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, c.take(pa.array(where))) for c in (source, pa.array(count))]
            return pa.RecordBatch.from_arrays([lang.take(pa.array(at)), term.take(pa.array(at)), pa.array(total[to] - total[at]), *lists], names=["lang", "term", "docs", "sources", "counts"])

        for x in batches:
            cols = [x[c] for c in ("lang", "term", "source", "docs", "count")]
            if rest is not None:
                cols = [pa.concat_arrays([a, b]) for a, b in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            first = _starts(*cols[:3])
            lang, term, source = (c.take(pa.array(first)) for c in cols[:3])
            docs, count = (np.add.reduceat(c.to_numpy(), first) for c in cols[3:])
            at = _starts(lang, term)
            yield rows(lang, term, source, docs, count, at[:-1], at[1:])
            rest = [lang[at[-1] :], term[at[-1] :], source[at[-1] :], pa.array(docs[at[-1] :]), pa.array(count[at[-1] :])]
        if rest is not None:
            yield rows(*rest[:3], rest[3].to_numpy(), rest[4].to_numpy(), np.zeros(1, dtype=np.int64), np.array([len(rest[0])]))

    return run


def kept_terms(docs: DataFrame, least: int = LEAST, block: int = ROWS, most: int = PART) -> DataFrame:
    """lang, term, docs, sources and counts of the terms in at least `least` documents of a language, by the first scan.

    `docs` has lang, source and text without nulls.
    """
    bounded_batches(docs.sparkSession)
    found = docs.select("lang", "source", "text").mapInArrow(_occurrences(block, most), "lang string, term string, source string, document long, docs long, count long")
    dealt = found.repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "document")
    return dealt.mapInArrow(_kept(least), "lang string, term string, docs long, sources array<string>, counts array<long>")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact; null without terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    below = F.when(terms > 0, (total + SMOOTH * terms).cast("decimal(20,0)"))
    return (F.floor((above - above % below) / below) + 1).cast("long")


_EMITTED = "lang string, source string, other string, term string, value long"


def _pairs_and_terms(most: int):
    """Second scan, over runs of (lang, term) in the order of their sources: partial pairs (other; a < b) and terms (term)."""

    def emitted(lang, source, other, term, value):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((lang, source, other, term, value), (*[pa.string()] * 4, pa.int64()), strict=True)], names=["lang", "source", "other", "term", "value"])

    def partial(lang: pa.Array, term: pa.Array, source: pa.Array, p: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums of whole runs by pair, about `most` pairs at a time, made of each row and the later ones of its run."""
        n = len(lang)
        at = np.append(_starts(lang, term), n)
        later = np.repeat(at[1:], np.diff(at)) - np.arange(n) - 1
        langs, sources = (c.dictionary_encode() for c in (lang, source))
        lang_of, source_of = (c.indices.to_numpy().astype(np.int64) for c in (langs, sources))
        lang_names, names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        upto = np.cumsum(later)
        row = 0
        while row < n:
            done = upto[row - 1] if row else 0
            to = max(row + 1, int(np.searchsorted(upto, done + most, side="right")))
            a = np.repeat(np.arange(row, to), later[row:to])
            b = np.arange(len(a)) - np.repeat(upto[row:to] - later[row:to] - done, later[row:to]) + a + 1
            row = to
            if not len(a):
                continue
            d = np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(p[b] - z[a]) + np.abs(z[a] - z[b])
            code = (lang_of[a] * len(names) + source_of[a]) * len(names) + source_of[b]
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            sums, code = np.add.reduceat(d[order], first), code[first]
            pair, other = code // len(names), code % len(names)
            yield emitted([lang_names[i] for i in (pair // len(names)).tolist()], [names[i] for i in (pair % len(names)).tolist()], [names[i] for i in other.tolist()], [None] * len(code), sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for x in batches:
            p, q = x["p"].to_numpy(), x["q"].to_numpy()
            up = pa.array(np.flatnonzero(p > q))
            yield emitted(x["lang"].take(up), x["source"].take(up), [None] * len(up), x["term"].take(up), (p - q)[p > q])
            held.append([x[c] for c in ("lang", "term", "source", "p", "zero")])
            rows += len(p)
            if rows >= most // 20:
                cols = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                last = int(_starts(*cols[:2])[-1])  # the last run may go on
                if last:
                    yield from partial(*(c[:last] for c in cols[:3]), *(c[:last].to_numpy() for c in cols[3:]))
                held, rows = [[c[last:] for c in cols]], len(cols[0]) - last
        if rows:
            cols = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
            yield from partial(*cols[:3], *(c.to_numpy() for c in cols[3:]))

    return run


def _lone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a pair owes to the terms of one side: both directions of each source with every other one of its language."""
    for x in batches:
        for lang, source, zero, v, values, times, others, zeros in zip(*(x[c] for c in ("lang", "source", "zero", "terms", "values", "times", "others", "zeros")), strict=True):
            z, names = np.asarray(zeros, dtype=np.int64), np.asarray(others, dtype=object)
            p, m = (np.asarray([] if y is None else y, dtype=np.int64) for y in (values, times))
            order = np.argsort(p)
            p, m = p[order], m[order]
            mass, count = np.concatenate([[0], np.cumsum(p * m)]), np.concatenate([[0], np.cumsum(m)])
            at = np.searchsorted(p, z)
            apart = mass[-1] - 2 * mass[at] - z * (count[-1] - 2 * count[at]) - count[-1] * np.abs(z - zero)
            mine = names != source
            names, apart, base = names[mine], apart[mine], (v * np.abs(z - zero))[mine]
            yield pd.DataFrame({"lang": lang, "source": source, "other": names, "value": apart + base})
            yield pd.DataFrame({"lang": lang, "source": names, "other": source, "value": apart})


def divergence(docs: DataFrame, least: int = LEAST, top: int = 50, block: int = ROWS, most: int = PART, pairs: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` has the distance of a source from each other one of its language,
    `term` the `top` terms whose share of a source is most above that of the language.

    `block`, `most` and `pairs` bound what a task holds (rows of a block, bytes of a text, pairs of sources); they change no
    result. The histogram of a source's shares has at most as many values as it has different counts (the root of twice its words).
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = staged(kept_terms(rows, least, block, most), "terms")
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("_x")).select("lang", "term", F.col("_x.sources").alias("source"), F.col("_x.counts").alias("count"))
    sums = each.groupBy("lang", "source").agg(F.sum("count").alias("_n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(v, "lang", "left")
    total, n = F.coalesce("_n", F.lit(0)), F.coalesce("terms", F.lit(0))
    groups = groups.select("lang", "source", total.alias("total"), n.alias("terms"), F.sum(total).over(W.partitionBy("lang")).alias("lang_total"))
    groups = staged(groups.withColumn("zero", F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0).cast("long"))), "groups")

    in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    runs = kept.select("lang", "term", in_lang.alias("_all"), F.explode(F.arrays_zip("sources", "counts")).alias("_x")).select("lang", "term", "_all", F.col("_x.sources").alias("source"), F.col("_x.counts").alias("count"))
    shares = runs.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", _share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), "zero", _share(F.col("_all"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    shares = staged(shares, "shares")
    scanned = staged(shares.repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_pairs_and_terms(pairs), _EMITTED), "runs")

    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("_h"))
    beside = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("_o"))
    sides = groups.join(histogram, ["lang", "source"], "left").join(beside, "lang").select(
        "lang", "source", "zero", "terms", F.col("_h.p").alias("values"), F.col("_h.m").alias("times"), F.col("_o.source").alias("others"), F.col("_o.zero").alias("zeros")
    )
    lone = sides.mapInPandas(_lone, "lang string, source string, other string, value long")
    common = scanned.where(F.col("other").isNotNull())
    both = common.select("lang", "source", "other", "value").union(common.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")).union(lone)
    sums_of = both.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    found = scanned.where(F.col("term").isNotNull()).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(sums_of).union(ranked(found).where(F.col("rank") <= top))
