"""Near-duplicate groups by HyperMinHash, with every link confirmed on the full shingle sets.

1. A document's distinct shingles are hashed to 64 bits. The upper 7 bits choose one of 128 buckets; of the least remainder
   in a bucket its number of leading zeros and 10 bits of mantissa are stored (16 bits). An empty bucket takes the register
   of the first full one in an order fixed for that bucket, so small sets have as many independent registers as large ones.
2. Documents with equal sets form a class, and only classes go on. Four registers at a time are packed into band keys.
   A pair at the least similarity of 0.8 shares none of the 32 bands with a probability of 5e-8.
3. In each band key all members are paired with one centre (a star). A Jaccard estimate from the registers, corrected for
   accidental collisions, drops pairs far below; the rest are confirmed on the full sets of the texts. Links give labels.
4. Keys whose members still have several labels are dealt into a grid of bounded blocks: members outside the key's main
   label against all. A block estimates and confirms in place (each pair under the first key it shares) and gives the links
   that join labels, never the pairs. So a group of near copies that the star has joined costs nothing more.

Null, empty or blank texts have no set, link with nothing and are their own component. Null ids: a document with a null id
is linked like others but never names a component; a component of null ids alone is null. Repeated rows share a class.
An empty table gives an empty result. Very long texts are hashed whole, in parts cut at white space. Columns other than the
id and the text are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .components import components
from .words import shingles, word_hashes

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
_SHIFT = np.uint64(57)
MANTISSA = 10
#: Estimates this far below the least similarity (over eight standard deviations of 128 registers) are not confirmed, and
#: those of sets of fewer shingles than SMALL, whose registers repeat each other, drop nothing.
SLACK, SMALL = 0.3, 128
#: Members and shingles of a block.
MEMBERS, SHINGLES = 512, 1 << 21


def _orders() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240101))
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_ORDERS = _orders()
_LIMITS = (np.arange(REGISTERS, dtype=np.uint64) << _SHIFT).astype(np.uint64)


def registers(distinct: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits of a set of 64-bit hashes in ascending order, not empty."""
    at = np.searchsorted(distinct, _LIMITS)
    bucket = np.concatenate([at[1:], [len(distinct)]]) > at
    rest = distinct[np.minimum(at, len(distinct) - 1)] & np.uint64((1 << 57) - 1)
    bits = (rest.astype(np.float64) + 1.0).view(np.uint64) >> np.uint64(52 - MANTISSA)  # exponent, then mantissa
    zeros = np.uint64(1023 + 57) - (bits >> np.uint64(MANTISSA))
    out = (np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA) | bits & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    if not bucket.all():
        empty = np.flatnonzero(~bucket)
        out[empty] = out[_ORDERS[empty, bucket[_ORDERS[empty]].argmax(axis=1)]]
    return out


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by accident, for sets of sizes a and b."""
    return 0.169919487159739 * 2.0**-MANTISSA * 4 * a * b / (a + b) ** 2


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, corrected for accidental collisions."""
    c = collisions(a, b)
    return np.maximum(agree - c, 0) / (1 - c)


_SIGNED = "doc_id long, th long, n_shingles long, node binary, regs binary"


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, nodes, regs = [], [], []
            for _, w in word_hashes(x["text"].to_pylist()):
                s = np.unique(shingles(w, words))
                n.append(len(s))
                if len(s):
                    regs.append(registers(s).tobytes())
                    with np.errstate(over="ignore"):
                        two = [int((s * np.uint64(0xFF51AFD7ED558CCD) ^ s >> np.uint64(31)).sum()), int((s ^ s * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(29)).sum())]
                    nodes.append(np.array([*two], dtype=np.uint64).tobytes())
                else:
                    regs.append(None)
                    nodes.append(None)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["th"], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "th", "n_shingles", "node", "regs"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (the set's fingerprint) and regs of each document; staged."""
    bounded_batches(docs.sparkSession)
    return staged(_slim(docs).mapInArrow(_sign(words), _SIGNED), "signatures")


def _key(band: int) -> Column:
    return F.xxhash64(F.substring("regs", band * 2 * ROWS + 1, 2 * ROWS), F.lit(band))


def _agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    near = (estimate((a == b).mean(axis=1), na, nb) >= least - SLACK) | (np.minimum(na, nb) < SMALL)
    return near & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)


def _table(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                fine = _agree(_table(x["ra"]), _table(x["rb"]), x["na"].to_numpy().astype(float), x["nb"].to_numpy().astype(float), least)
                yield x.select(["a", "b", "na", "nb"]).filter(pa.array(fine))

    return run


def _block_links(words: int, percent: int):
    """Links that join different labels within a block of a band key: `left` rows against the others, each pair under the first
    band it shares; candidates by estimate, links by the full sets."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    least = percent / 100

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("node", "ascending")])
        band, node, regs = t["band"][0].as_py(), t["node"].to_pylist(), _table(t["regs"])
        left, out = np.flatnonzero(t["left"].to_numpy()), t["out"].to_numpy()
        right = np.flatnonzero(~t["left"].to_numpy())
        n = t["n_shingles"].to_numpy().astype(float)
        label = np.unique(np.array([x.hex() for x in t["label"].to_pylist()]), return_inverse=True)[1]
        keys = regs.view(np.uint64).reshape(len(regs), BANDS)
        parent = np.arange(label.max() + 1)
        a, b, sets = [], [], None
        for p in left:
            # of two rows outside the main label the lesser one is the left one
            q = right[(parent[label[right]] != parent[label[p]]) & (~out[right] | np.array([node[p] < node[k] for k in right], dtype=bool))]
            if band and len(q):
                q = q[(keys[q, :band] != keys[p, :band]).all(axis=1)]
            if len(q):
                q = q[_agree(regs[q], regs[p][None, :], n[q], np.full(len(q), n[p]), least)]
            if not len(q):
                continue
            if sets is None:
                sets = [np.unique(shingles(w, words)) for _, w in word_hashes(t["text"].to_pylist())]
                flat, codes = np.unique(np.concatenate(sets), return_inverse=True)
                ends = np.cumsum([len(x) for x in sets])
                sets = [codes[e - len(x) : e] for e, x in zip(ends, sets, strict=True)]
            has = np.zeros(len(flat), dtype=bool)
            has[sets[p]] = True
            for k in q:
                if parent[label[k]] == parent[label[p]]:
                    continue
                both = int(has[sets[k]].sum())
                if 100 * both >= percent * (len(sets[p]) + len(sets[k]) - both):
                    a.append(node[p])
                    b.append(node[k])
                    parent[parent == parent[label[k]]] = parent[label[p]]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def _confirm(words: int, percent: int):
    """Links among the pairs of a cell, from the full texts; pairs that other links of the cell already join are left out."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = dict(zip(texts["node"].to_pylist(), (np.unique(shingles(w, words)) for _, w in word_hashes(texts["text"].to_pylist())), strict=True)) if pairs.num_rows else {}
        parent = {x: x for x in sets}

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            if top(x) == top(y):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[top(x)] = top(y)
                a.append(x)
                b.append(y)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) among `pairs` (cell, a, b), with `texts` (node, text)."""
    members = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    fetched = members.join(texts, "node").select(F.col("cell").alias("place"), "node", "text")
    return pairs.groupBy("cell").cogroup(fetched.groupBy("place")).applyInArrow(_confirm(words, percent), "a binary, b binary")


def labelled(docs: DataFrame, words: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The signatures of `docs`, and node and label for every class that is linked with another."""
    least = percent / 100
    rows = signed(docs, words)
    of_class = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("k"), "th")).alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("regs").alias("regs"))
    classes = staged(of_class, "classes")
    keyed = classes.select("node", "n_shingles", F.posexplode(F.array(*[_key(b) for b in range(BANDS)])).alias("band", "key"))
    # written, so that the join below stands alone and its hot keys can be split
    stars = staged(keyed.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("_count"), F.sum("n_shingles").alias("_size")).where(F.col("_count") > 1), "stars")
    members = staged(keyed.join(stars, "key").select("key", "band", "node", "n_shingles", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("nc"), "_count", "_size"), "members")
    # the star: one centre a key
    pairs = members.where((F.col("node") != F.col("centre")) & (F.least("n_shingles", "nc") >= least * F.greatest("n_shingles", "nc") - 1e-9))
    pairs = pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    near = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated(least), "a binary, b binary, na long, nb long"), "pairs")
    # texts of classes that share a key with another
    wanted = members.select("node").distinct().join(classes.select("node", "rep.k", "rep.th"), "node")
    keyed_docs = _slim(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("k"), "th", "text").where(F.col("text").isNotNull())
    # grouped by the join's keys too, so that texts are dealt once
    texts = staged(keyed_docs.join(wanted, ["k", "th"]).groupBy("k", "th", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts", compression="zstd")
    size = staged(near.groupBy("a").agg(F.count(F.lit(1)).alias("_count"), F.sum("nb").alias("_size")), "sizes")
    spread = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("_count") / MEMBERS), F.ceil(F.col("_size") / SHINGLES)))
    star_cells = near.join(size, "a").select(F.concat_ws(":", F.hex("a"), spread.cast("string")).alias("cell"), "a", "b")
    first = staged(_confirmed(star_cells, texts, words, percent), "first")
    # what the star has not joined: blocks of keys with several labels
    labels = components(first)
    known = members.where("_count > 2").join(labels, "node", "left").where(F.col("node") != F.col("centre")).select("key", "band", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    each = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    total = each.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "size")).alias("m"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / MEMBERS), F.ceil(size / SHINGLES)).cast("int")
    several = staged(total.where("labels > 1").select("key", "main", blocks(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("_ni"), blocks(F.col("n"), F.col("size")).alias("_nj")), "keys")
    rows_of = staged(known.join(several, "key").withColumn("out", F.col("label") != F.col("main")), "several")
    if rows_of.isEmpty():
        return rows, labels
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = rows_of.where("out").withColumn("left", F.lit(True)).withColumn("_i", block("_ni")).withColumn("_j", every("_nj"))
    rights = rows_of.withColumn("left", F.lit(False)).withColumn("_j", block("_nj")).withColumn("_i", every("_ni"))
    laid = lefts.unionByName(rights).select("key", "_i", "_j", "band", "node", "n_shingles", "label", "left", "out")
    full = laid.join(classes.select("node", "regs").join(texts, "node"), "node")
    second = staged(full.groupBy("key", "_i", "_j").applyInArrow(_block_links(words, percent), "a binary, b binary"), "second")
    return rows, components(first.union(second))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    rows, labels = labelled(docs, words, percent)
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = named.join(ids, "label").select("node", "component_id")
    has = rows.where(F.col("node").isNotNull()).select("doc_id", "n_shingles", "node").join(of_class, "node").select("doc_id", "n_shingles", "component_id")
    none = rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return has.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: that of the least id, and of repeated ids the least text hash."""
    rows, labels = labelled(docs, words, percent)
    key = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(-1)).alias("k"), "th")
    named = rows.where(F.col("node").isNotNull()).join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), key().alias("key"))
    best = named.groupBy("label").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).select("key.k", "key.th", F.lit(True).alias("_stays"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col("text").cast("string")
    mine = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64(text).alias("th"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_has"))
    stays = mine.join(best, ["k", "th"], "left").where(F.col("_stays") | ~F.col("_has")).select("k", "th", "_has", "_row")
    repeated = staged(rows.where(F.col("node").isNotNull()).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("k"), "th").count().where("count > 1").join(best, ["k", "th"], "left_semi"), "repeated")
    if repeated.isEmpty():
        return stays.select("_row.*")
    # rows repeated with id and text: the first in the order of all columns stays
    once = stays.where("_has").groupBy("k", "th").agg(F.min("_row").alias("_row"))
    return once.select("_row.*").union(stays.where("NOT _has").select("_row.*"))
