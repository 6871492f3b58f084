"""Token ids in Parquet: list columns with dictionary encoding, small row groups and pages with indexes.

Documents are dealt by ranges of doc_id and sorted within, encoded by the public tokenizer, and written in that order, one
file a range. Beside the ids a file holds doc_id, the number of tokens and the place of the first token within the file, so
lengths and places can be read without the ids, and single documents by row group and page.

Null text is empty: the end id alone. Null ids come first; rows with equal ids are ordered by text, and repeated rows are
written as often as they stand. Very long texts are coded in parts of about a megabyte, cut where the tokenizer cuts for
certain. A special token's literal in a text becomes that token, as the library does by itself, and is never cut. An empty
table gives an empty result. Columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, staged
from .pieces import PieceCoder

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Row groups of about 8 MB of ids, pages of 64 KB: a reader of one document fetches little else.
LAYOUT = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10), "parquet.enable.dictionary": "true", "compression": "zstd"}
SCHEMA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    literals = [str(t.content).encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(pieces: list[bytes]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        ids, sizes = array("I"), []
        for x in tokenizer.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in pieces], add_special_tokens=False):
            ids.extend(found := x.ids)
            sizes.append(len(found))
        return {"ids": (np.frombuffer(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64))}

    same = [tokenizer.encode(x, add_special_tokens=False).ids for x in (" Ab. X", "ab. x")]
    return PieceCoder(encode, whole=literals, loose=same[0] == same[1])


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, place, shard = coder(path), 0, TaskContext.get().partitionId()
        tail = np.array([end], dtype=np.uint32)

        def batch(doc_ids, values, sizes, places):
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int32)))
            n = len(sizes)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(n, shard, dtype=np.int32)), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), ids], names=["doc_id", "shard", "place", "n_tokens", "ids"])

        for x in batches:
            doc_ids, kept, values, sizes, places, held = x["doc_id"].to_pylist(), [], [], [], [], 0
            for i, ids, _ in code.encode(x["text"].to_pylist()):
                values += [*ids, tail]
                size = sum(map(len, ids)) + 1
                kept.append(doc_ids[i])
                sizes.append(size)
                places.append(place)
                place += size
                held += size
                if held > 1_000_000:
                    yield batch(kept, values, sizes, places)
                    kept, values, sizes, places, held = [], [], [], [], 0
            if kept:
                yield batch(kept, values, sizes, places)

    return run


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """The token files of `docs`, read back."""
    bounded_batches(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(_encode(public_tokenizers.path(tokenizer), end), SCHEMA), "tokens", **LAYOUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ids = x["ids"]
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([x["doc_id"], x["shard"], x["place"], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in token files."""
    read = tokens.select("doc_id", "shard", "place", "ids").mapInArrow(_digest, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    # one row a file: lengths alone are read, not ids
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_before"))
    return read.join(F.broadcast(before), "shard").select("doc_id", (F.col("_before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
