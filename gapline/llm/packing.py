"""Packing of documents into windows of tokens by lexical retrieval: neighbours of a seed document fill its window.

Documents are encoded, an end id each. Whole windows of a long document stand by themselves; what is left of each document is
a piece in the pool. The pool is dealt into shards of bounded size in the order of a lexical key (the piece's two rarest tokens
by the vocabulary's order), so that like pieces meet; a key that many pieces share goes on over shards. Each shard has a BM25
inverted index of its pieces, with the document frequencies and the mean length of the whole pool. Pieces become seeds in
order: a seed asks the index for its most telling terms and its window takes the unused neighbours from the best on, and after
those with a score the next unused ones. The last one is cut where the window is full, and its rest is the next seed. The last
window of a shard, which nothing can fill, is cut into sequences whose lengths are powers of two, so that nothing is padded.

Terms are token ids, so tables of them are bounded by the vocabulary. Terms in more than half of the pool have no weight.

Null text is empty: the end id alone. Rows are documents: repeated rows and null ids are packed each. Texts of any length are
coded whole. Of equal scores the earlier piece in the shard's order is taken. An empty table gives an empty result. A special
token's literal in a text becomes that token, as the library does by itself. Columns other than doc_id and text are not read,
so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, staged
from .tokenfiles import coder

TOKENIZER = "word_bpe_49k.json"
#: A document's end, the tokens of a sequence, the ids of the vocabulary (at most 65 536).
END, WINDOW, VOCABULARY = 1, 2048, 49_408
#: Tokens of a shard, and of a partition of shards at most.
SHARD, DEALT = 4_000_000, 32_000_000
#: Terms of a query, and BM25's saturation and length parameters.
TERMS, K1, B = 24, 1.2, 0.75

_POOL = "uid long, doc_id long, start long, length int, doc_tokens long, key long, crc long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _key(ids: np.ndarray) -> int:
    """The two greatest ids, which are the rarest in a vocabulary in the order of merges."""
    distinct = np.unique(ids)[-2:]
    return int(distinct[-1]) << 16 | int(distinct[0])


def _encoded(path: str, window: int, end: int, with_ids: bool):
    """Whole windows (with their crc) and the rest of each document (with its ids)."""
    names = [f.split()[0] for f in _POOL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, uid = coder(path), TaskContext.get().partitionId() << 40
        tail = np.array([end], dtype=np.uint16)
        for x in batches:
            doc_ids, rows, held = x["doc_id"].to_pylist(), [], 0
            for i, parts, _ in code.encode(x["text"].to_pylist()):
                ids = np.concatenate([*parts, tail]).astype("<u2")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    whole = len(piece) == window
                    rows.append((uid, doc_ids[i], start, len(piece), len(ids), None if whole else _key(piece), _crc(piece) if whole else None, None if whole and not with_ids else piece.tobytes()))
                    uid += 1
                held += len(ids)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _frequencies(vocabulary: int):
    """How many pieces of the task each token is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, dtype=np.int64)
        for x in batches:
            for ids in x["ids"]:
                n[np.unique(np.frombuffer(ids.as_buffer(), dtype="<u2"))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["token", "n"])

    return run


class Shard:
    """A BM25 index of the pieces of a shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float, terms: int = TERMS):
        self.pieces, self.idf, self.terms = pieces, idf, terms
        lengths = np.array([len(p) for p in pieces])
        flat = np.concatenate(pieces)
        number = np.repeat(np.arange(len(pieces)), lengths)
        told = idf[flat] > 0
        pairs, tf = np.unique(flat[told].astype(np.int64) * len(pieces) + number[told], return_counts=True)
        self.piece = pairs % len(pieces)
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.piece] / mean))
        self.begin = np.searchsorted(pairs, np.arange(len(idf) + 1) * len(pieces))

    def query(self, ids: np.ndarray) -> np.ndarray:
        """The most telling terms of a piece."""
        t, tf = np.unique(ids[self.idf[ids] > 0], return_counts=True)
        return t[np.argsort(-self.idf[t] * tf / (tf + K1), kind="stable")[: self.terms]]

    def neighbours(self, seed: int, unused: np.ndarray, first: int = 32) -> Iterator[np.ndarray]:
        """Unused pieces with a score, from the best on: about the `first` ones, then the others."""
        terms = self.query(self.pieces[seed])
        if not len(terms):
            return
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms.tolist()]
        found = np.concatenate([self.piece[s] for s in spans])
        value = np.concatenate([self.weight[s] * self.idf[t] for s, t in zip(spans, terms, strict=True)])
        score = np.bincount(found, weights=value, minlength=len(self.pieces))
        score[~unused] = 0
        at = np.flatnonzero(score)
        best = score[at]
        least = np.partition(best, len(best) - first)[len(best) - first] if len(best) > first else 0
        for part in (at[best >= least], at[best < least]):
            yield part[np.argsort(-score[part], kind="stable")]


def fill(shard: Shard, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of a shard as (piece, start in it, length): all but the last are full."""
    n = len(shard.pieces)
    lengths = [len(p) for p in shard.pieces]
    unused, after = np.ones(n, dtype=bool), 0
    rest: tuple[int, int, int] | None = None
    while True:
        while after < n and not unused[after]:
            after += 1
        if rest is None and after == n:
            return
        if rest is None:
            rest = (after, 0, lengths[after])
            unused[after] = False
        took, room, seed, rest = [rest], window - rest[2], rest[0], None

        def take(i: int):
            nonlocal room, rest
            unused[i] = False
            part = min(room, lengths[i])
            took.append((i, 0, part))
            room -= part
            if part < lengths[i]:
                rest = (i, part, lengths[i] - part)

        for part in shard.neighbours(seed, unused) if room else ():
            for i in part.tolist():
                if room:
                    take(i)
            if not room:
                break
        while room and after < n:
            if unused[after]:
                take(after)
            after += 1
        yield took


def _powers(took: list[tuple[int, int, int]], total: int, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The last window of a shard in sequences of powers of two, the longest first."""
    size = window
    left = list(took)
    while total:
        while size > total:
            size //= 2
        out, room = [], size
        while room:
            i, start, n = left.pop(0)
            part = min(n, room)
            out.append((i, start, part))
            room -= part
            if part < n:
                left.insert(0, (i, start + part, n - part))
        total -= size
        yield out


def _packed(window: int, shard_tokens: int, idf, mean: float, terms: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * with_ids
        held: list[tuple[int | None, int, int]] = []
        pieces: list[np.ndarray] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, pieces, size
            cols: list[list] = [[] for _ in names]
            for took in fill(Shard(pieces, idf.value, mean, terms), window):
                total = sum(n for _, _, n in took)
                for sequence in [took] if total == window else _powers(took, total, window):
                    offset = 0
                    for i, start, n in sequence:
                        doc_id, first, doc_tokens = held[i]
                        ids = pieces[i][start : start + n]
                        row = (doc_id, first + start, n, _crc(ids), doc_tokens, 2 * number + 1, offset, *([ids.astype(np.int32)] * with_ids))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        offset += n
                    number += 1
            held, pieces, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], *[pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]], names=names)

        for x in batches:
            for doc_id, start, doc_tokens, ids in zip(*(x[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                held.append((doc_id, start, doc_tokens))
                pieces.append(np.frombuffer(ids, dtype="<u2"))
                size += len(pieces[-1])
                if size >= shard_tokens:
                    yield from shard()
        if held:
            yield from shard()

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids as whole numbers instead of bytes."""
    for x in batches:
        ids = [np.frombuffer(b, dtype="<u2").astype(np.int32) for b in x["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=x.schema.names)


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD, terms: int = TERMS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece and, `with_ids`, its ids.

    `window` is a power of two. `shard_tokens` bounds what a task holds; `terms` is the length of the queries.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = staged(rows.mapInArrow(_encoded(public_tokenizers.path(tokenizer), window, end, with_ids), _POOL), "coded", compression="zstd")
    pool = coded.where("key is not null")
    n, tokens = pool.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    counted = pool.select("ids").mapInArrow(_frequencies(VOCABULARY), "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    df = np.zeros(VOCABULARY, dtype=np.int64)
    for r in counted.collect():  # at most a row for each id of the vocabulary
        df[r.token] = r.n
    idf = spark.sparkContext.broadcast(np.where(df > 0, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0), 0.0))
    parts = max(shuffle_partitions(spark), -(-tokens // DEALT))
    dealt = pool.select("key", "uid", "doc_id", "start", "doc_tokens", "ids").repartitionByRange(parts, "key", "uid").sortWithinPartitions("key", "uid")
    found = dealt.mapInArrow(_packed(window, shard_tokens, idf, tokens / max(n, 1), terms, with_ids), _PIECES + ", ids array<int>" * with_ids)
    whole = coded.where("key is null").select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    return found.union(whole.mapInArrow(_listed, found.schema) if with_ids else whole)
