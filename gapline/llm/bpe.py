"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Words are the matches of the public pattern. The words of a block that are new to the worker become rows of a word and its
tokens, one for each byte at first. A turn of the recursion joins the token positions to the merge table (every pair of tokens
whose bytes together are a token), contracts each word's leftmost pair of least rank, and goes on with the words that had
one, until none has. A word that is a token as a whole is that token, as in the tiktoken library. Decoding joins the ids to
the vocabulary and aggregates the bytes in order; nothing of the text goes into it.

A word of more than LONG bytes takes the same turns for many places at once. A pair of rank r is contracted where no pair of
lesser rank, nor one of the same rank further left, stands within `reach` tokens on either side, `reach` being the bytes of the
longest token below r. What comes before r elsewhere makes tokens below r only, and to touch this pair one of them would have
to cover all tokens in between, which is more than it can hold. So the result is that of one contraction after the other. Where
r is in no pair of lesser rank, its places do not wait for each other, but for those that overlap, every second of which is
contracted from the left.

Null text is empty: no ids. Very long texts are coded in parts of about a megabyte, cut where a match ends for certain; a
single word may be of any length. DuckDB works in memory alone: what a query holds follows from the bytes given to it, a block or
one longer word, and no temporary folder is used. Repeated rows and null ids are rows like others. An empty table gives an empty result.
Columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .pieces import PieceCoder, gathered

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words of one recursive query, and bytes from which on a word is a long one.
WORDS, LONG = 20_000, 64
#: Pieces remembered by a worker (about 80 MB), beyond which it starts anew, and bytes of text handled at once.
PIECES, BLOCK = 1_000_000, 1 << 20
#: Documents of a batch that are unpacked at once.
ROWS = 1_000

#: A turn contracts the leftmost pair of least rank in each word.
_CONTRACT = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM start
  UNION
  (WITH best AS (
     SELECT word, min(m.id::BIGINT * 4294967296 + idx) AS k
     FROM (SELECT word, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS idx FROM step) JOIN merges m USING (a, b)
     GROUP BY word
   ), place AS (SELECT word, (k // 4294967296)::INTEGER AS id, k % 4294967296 AS i FROM best)
   SELECT word, toks[:i-1] || [id] || toks[i+2:] AS toks FROM step JOIN place USING (word))
)
SELECT word, toks AS ids FROM step ORDER BY word
"""

#: For long words: a turn contracts every pair that no other one can come before.
_CONTRACT_LONG = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM start
  UNION
  (WITH pairs AS (
     SELECT p.word, p.idx, p.tok, m.id, m.lower, coalesce(m.reach, 0) AS reach, m.id::BIGINT * 4294967296 + p.idx AS k
     FROM (SELECT word, unnest(toks) AS tok, unnest(toks[2:] || [NULL]) AS b, unnest(range(1, len(toks) + 1)) AS idx FROM step) p
     LEFT JOIN merges m ON m.a = p.tok AND m.b = p.b
   ), least AS (
     SELECT *, min(k) OVER (PARTITION BY word ORDER BY idx ROWS BETWEEN reach PRECEDING AND reach FOLLOWING) AS m,
       lag(id) OVER (PARTITION BY word ORDER BY idx) IS DISTINCT FROM id AS new FROM pairs
   ), runs AS (SELECT *, max(CASE WHEN new THEN idx END) OVER (PARTITION BY word ORDER BY idx) AS run FROM least
   ), taken AS (
     SELECT word, idx, tok, id, coalesce(CASE WHEN lower THEN k = m
       ELSE (idx - run) % 2 = 0 AND bool_and(id = m // 4294967296) OVER (PARTITION BY word, run ORDER BY idx) END, false) AS take FROM runs
   ), gone AS (
     SELECT word, idx, CASE WHEN take THEN id ELSE tok END AS tok, take, lag(take, 1, false) OVER (PARTITION BY word ORDER BY idx) AS gone FROM taken
   )
   SELECT word, list(tok ORDER BY idx) AS toks FROM gone WHERE NOT gone GROUP BY word HAVING bool_or(take))
)
SELECT word, toks AS ids FROM step ORDER BY word
"""

_DECODE = """
SELECT text, string_agg(v.hex, '' ORDER BY pos) AS bytes
FROM tokens JOIN vocabulary v USING (id) GROUP BY text ORDER BY text
"""


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, pieces: int = PIECES, block: int = BLOCK):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        splits = pd.DataFrame(splits, columns=["a", "b", "id"], dtype="int32")  # noqa: F841
        vocabulary = pd.DataFrame([(r, t.hex(), len(t)) for t, r in self.ranks.items()], columns=["id", "hex", "size"])  # noqa: F841
        # lower: a token that is in a pair of lower rank; reach: bytes of the longest token below
        self.db.execute("""
            CREATE TABLE merges AS
            SELECT a, b, id, reach::INTEGER AS reach, id IN (SELECT t FROM (SELECT a AS t, id FROM splits UNION ALL SELECT b, id FROM splits) WHERE id < t) AS lower
            FROM splits JOIN (SELECT id, coalesce(max(size) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS reach FROM vocabulary) USING (id);
            CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, hex FROM vocabulary""")
        self.pieces = PieceCoder(self._pieces, pieces, most=block)

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and their number in each word."""
        flat, sizes = [np.zeros(0, dtype=np.int32)], np.zeros(len(words), dtype=np.int64)
        length = np.array([len(w) for w in words], dtype=np.int64)
        order = []
        for query, which in ((_CONTRACT, np.flatnonzero(length <= LONG)), (_CONTRACT_LONG, np.flatnonzero(length > LONG))):
            upto = np.cumsum(length[which])
            at = 0
            while at < len(which):  # WORDS words or half a megabyte at a time
                to = min(at + WORDS, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 19)))))
                part = [words[i] for i in which[at:to].tolist()]
                ends = np.concatenate([[0], np.cumsum(length[which[at:to]])]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[np.frombuffer(b"".join(part), dtype=np.uint8)]))
                start = pa.table({"word": pa.array(np.arange(len(part), dtype=np.int32)), "toks": toks})  # noqa: F841
                ids = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
                flat.append(ids.values.to_numpy())
                sizes[which[at:to]] = np.diff(ids.offsets.to_numpy())
                order.append(which[at:to])
                at = to
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        begin = np.zeros(len(words), dtype=np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat)[gathered(begin, sizes)], sizes

    def _pieces(self, pieces: list[bytes]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        split = [self.pattern.findall(p.decode("utf-8", "surrogatepass")) for p in pieces]
        number: dict[str, int] = {}
        words = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.int64)
        named = [w.encode("utf-8", "surrogatepass") for w in number]
        whole = np.array([self.ranks.get(w, -1) for w in named], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, n = self._contracted([named[i] for i in rest.tolist()])
        sizes = np.ones(len(named), dtype=np.int64)
        sizes[rest] = n
        flat = np.repeat(whole, sizes)
        flat[flat < 0] = ids
        flat = flat[gathered((np.cumsum(sizes) - sizes)[words], sizes[words])].astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(sizes[words])])
        sizes = np.diff(upto[np.concatenate([[0], np.cumsum([len(ws) for ws in split])])])
        return {"ids": (flat, sizes), "bytes": self._bytes(flat, sizes)}

    def _bytes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that lists of ids stand for, end to end, and their number in each list."""
        out, n = [np.zeros(0, dtype=np.uint8)], np.zeros(len(sizes), dtype=np.int64)
        upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < len(sizes):  # about a hundred thousand ids at a time
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + 100_000)) - 1)
            tokens = pa.table({"text": np.repeat(np.arange(at, to), sizes[at:to]), "pos": np.arange(upto[at], upto[to]), "id": flat[upto[at] : upto[to]].astype(np.int32)})  # noqa: F841
            got = self.db.sql(_DECODE).to_arrow_table()
            text, found = got["text"].to_numpy(), got["bytes"].combine_chunks()
            n[text] = pc.binary_length(found).to_numpy(zero_copy_only=False) // 2
            out.append(np.frombuffer(bytes.fromhex("".join(found.to_pylist())), dtype=np.uint8))
            at = to
        return np.concatenate(out), n

    def decode(self, ids: list) -> list[bytes]:
        """The bytes that each list of ids stands for; null is empty."""
        lists = [np.asarray([] if x is None else x, dtype=np.uint32) for x in ids]
        flat, sizes = self._bytes(np.concatenate([np.zeros(0, dtype=np.uint32), *lists]), np.array([len(x) for x in lists], dtype=np.int64))
        return [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if ids else []


@lru_cache(maxsize=2)
def _codec(path: str, pieces: int = PIECES, block: int = BLOCK) -> Codec:
    return Codec(path, pieces=pieces, block=block)


def _encode(path: str, with_ids: bool, pieces: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pieces, block)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for x in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            doc_ids, rows, held = x["doc_id"].to_pylist(), [], 0

            def batch(rows):
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([r[1] for r in rows])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in rows]).view(np.int32))))
                return pa.RecordBatch.from_arrays(cols, names=names)

            for i, ids, back in codec.pieces.encode(x["text"].to_pylist(), decode=True):
                whole = np.concatenate(ids) if len(ids) > 1 else ids[0]
                decoded = hashlib.sha256()
                for part in back:
                    decoded.update(part)
                rows.append((doc_ids[i], len(whole), hashlib.sha256(whole.astype("<u4", copy=False).tobytes()).hexdigest(), decoded.hexdigest(), whole if with_ids else None))
                held += len(whole)
                if held > 1_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def encoded(docs: DataFrame, ranks: str = RANKS, with_ids: bool = True, pieces: int = PIECES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes and, with `with_ids`, the ids of each document.

    `pieces` and `block` bound what a worker holds (pieces remembered, bytes of text at once); they change no result.
    """
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_encode(public_tokenizers.path(ranks), with_ids, pieces, block), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decoded(tokens: DataFrame, ranks: str = RANKS) -> DataFrame:
    """`doc_id` and `bytes` for each row of doc_id and ids: what the ids stand for."""
    path = public_tokenizers.path(ranks)
    bounded_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for x in batches:
            for part in (x.slice(i, 100) for i in range(0, x.num_rows, 100)):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(codec.decode(part["ids"].to_pylist()), pa.binary())], names=["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
