"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks.

Vectors are turned into whole-number components and dealt at random into blocks of bounded size. Every block of queries
meets every block of candidates once, in a task of its own: the candidates' components are stored as postings by term
(component number), each query row scatters its weighted postings into a dense score array, a partition selects the best k
with ties to the smaller id, and the selections are merged by query. The grid's cells are equi-joined on their number.

Vectors that are null or hold null or non-finite components take no part. A vector of zeros or of no components scores 0
with all. Vectors of different lengths: missing components count as 0. Null ids: no query; as candidates last among ties.
Repeated rows are separate candidates (a row never meets itself) and separate queries. Scores are exact: where a block's sums
might pass 64 bits they are taken in whole numbers of any size, and a best score that no long can hold is an error, as is a
component. Vectors of any length are taken whole. An empty table, or one without queries: empty result. Columns other than
the id and the vector are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

CANDIDATES, QUERIES = 4096, 4096


def quantised(vectors: DataFrame, scale: float = 1024.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of whole numbers) and uid for each vector that takes part; staged."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.when(F.abs(F.lit(scale) * c) < float(2**63), F.floor(F.lit(scale) * c)).otherwise(F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long")))
    return staged(vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("uid")), "vectors")


def _dense(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), dtype=np.int64)
    flat = column.combine_chunks()
    ends = np.asarray(flat.offsets)
    n = np.diff(ends)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], n)] = np.asarray(flat.flatten())
    return out


def _cell(k: int):
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = schema.empty_table()
        if not queries.num_rows or not candidates.num_rows:
            return empty
        ids = candidates["c_vec_id"].to_pandas().astype("Int64")
        last = ids.isna().to_numpy()
        ids = ids.fillna(0).to_numpy(dtype=np.int64)
        uids = candidates["c_uid"].to_numpy()
        order = np.lexsort((uids, ids, last))  # ascending ids: among equal scores an earlier place wins
        ids, last, uids = ids[order], last[order], uids[order]
        dims = max(int(np.diff(np.asarray(t.combine_chunks().offsets)).max(initial=0)) for t in (queries["v"], candidates["c_v"]))
        c, q = _dense(candidates["c_v"], dims)[order], _dense(queries["v"], dims)
        if dims * int(np.abs(c.astype(float)).max(initial=0)) * int(np.abs(q.astype(float)).max(initial=0)) >= 2**62:
            c, q = c.astype(object), q.astype(object)
        postings = []
        for d in range(dims):
            at = np.flatnonzero(c[:, d])
            postings.append((slice(None) if len(at) == len(c) else at, c[at, d].copy()))
        place = {u: i for i, u in enumerate(uids.tolist())}
        out = []
        for uid, qid, terms in zip(queries["uid"].to_pylist(), queries["vec_id"].to_pylist(), q, strict=True):
            score = np.zeros(len(c), dtype=c.dtype)
            for d in np.flatnonzero(terms):
                at, weights = postings[d]
                score[at] += terms[d] * weights
            alive = np.ones(len(c), dtype=bool)
            if uid in place:
                alive[place[uid]] = False
            at = np.flatnonzero(alive)
            if len(at) > k:
                bar = (np.sort if score.dtype == object else lambda v: np.partition(v, len(at) - k))(score[at])[len(at) - k]
                over = at[score[at] > bar]
                at = np.concatenate([over, at[score[at] == bar][: k - len(over)]])
            out += [(uid, qid, None if last[i] else int(ids[i]), int(score[i])) for i in at]
        return pa.table(list(map(pa.array, zip(*out, strict=True))), schema=schema) if out else empty

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (of quantised()) where `is_query` holds, its k best others."""
    queries = vectors.where(F.coalesce(is_query, F.lit(False)))
    n_c, n_q = vectors.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // CANDIDATES)), max(1, -(-n_q // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("uid", "vec_id", "v", block(q_blocks).alias("qb")).withColumn("cb", all_of(c_blocks))
    # names of their own: the sides stem from one table, and pruning would mix up equal ones
    right = vectors.select(F.col("uid").alias("c_uid"), F.col("vec_id").alias("c_vec_id"), F.col("v").alias("c_v"), block(c_blocks).alias("c_cb")).withColumn("c_qb", all_of(q_blocks))
    cells = left.groupBy("qb", "cb").cogroup(right.groupBy("c_qb", "c_cb")).applyInArrow(_cell(k), "uid long, query_id long, vec_id long, score long")
    w = W.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
