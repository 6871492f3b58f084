"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of 60 bits of its id and text. A source's target is a number of whole copies plus a rest; the rest
is met by the documents whose hash lies under a threshold. The threshold is found without sorting documents: sizes are
summed by source and hash bucket of 12 bits, the bucket in which the running sum passes the rest is found, and only that
bucket's documents are summed by the next 12 bits, until the hash is used up. The document at the threshold goes in if that
brings the sum nearer to the target.

The sources are a table of their own, with one row for each: their order (ranks within ranges, and a range's offset), the
level up to which all are filled (sums alone come to the driver, a few numbers a round) and the thresholds stay there.

Null text: size 0. Null source: a source of its own, last in the order. Sources with no words: target 0. Rows repeated in
full (id and text) share a hash and are taken alike. Null ids are told apart by their text. Very long texts are counted
whole. Extra columns are carried along as they are, whatever their names. An empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, staged

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
BITS, LEVELS = 12, 5
#: One row for each source is broadcast as long as there are no more sources than this.
BROADCAST_SOURCES = 100_000


def _hash() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _source() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source").cast("string")))


def measured(docs: DataFrame) -> DataFrame:
    """doc columns of `docs` are replaced by: doc_id, size, _s (source with its nulls told apart) and _h (60 bits)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"), _source().alias("_s"), _hash().alias("_h"))


def _ranked(totals: DataFrame) -> DataFrame:
    """`totals` with _r, the place (from 0) in code-point order, null last; staged."""
    null = F.col("_s") == "n"
    dealt = staged(totals.repartitionByRange(null, "_s").withColumn("_part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(null, "_s"))
    return dealt.withColumn("_i", place).join(F.broadcast(before), "_part").withColumn("_r", F.col("_before") + F.col("_i") - 1).drop("_part", "_i", "_before")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`totals` (_s, total) with the target of each source: `share` of all sizes by weight, none above `most` times its own, the
    excess reshared until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_r") % len(weights) + 1).cast("int"))
    rows = staged(_ranked(totals).withColumn("_w", weight.cast("double")), "weights")
    level, full = 0.0, -1
    while True:  # the level only rises, so what is full stays full
        above = F.lit(level) * F.col("_w") > most * F.col("total")
        r = rows.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, most * F.col("total"))).alias("full"), F.sum("total").alias("all"), F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], max(share * (r["all"] or 0) - (r["full"] or 0.0), 0.0) / r["w"]
    return rows.select("_s", "total", F.least(most * F.col("total"), F.lit(level) * F.col("_w") if r["w"] else F.lit(float("inf"))).alias("target"))


def planned(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of `rows` (of measured()): _s, source_size, target, whole copies of every document, and the threshold: documents
    with a hash below _cut (or equal to it, where _edge) are taken once more. Few sources are broadcast."""
    goal = targets(rows.groupBy("_s").agg(F.sum("size").alias("total")), weights, share, most)
    copies = F.when(F.col("total") > 0, F.least(F.floor(F.col("target") / F.col("total")), F.lit(int(most)))).otherwise(0).cast("int")
    state = goal.select("_s", "total", "target", copies.alias("_copies"), (F.col("target") - copies * F.col("total")).alias("_left"), F.lit(0).cast("long").alias("_cut"))
    state = staged(state, "mix")
    few = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = lambda df: F.broadcast(df) if few else df
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.where(F.col("size") > 0).join(small(state.select("_s", "_left", "_cut")), "_s").where(F.shiftright("_h", shift + BITS) == F.col("_cut"))
        sums = inside.groupBy("_s", "_left", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_n"))
        run = sums.withColumn("_run", F.sum("_n").over(W.partitionBy("_s").orderBy("_b")))  # at most 2^BITS rows a source
        # the first bucket that passes what is left; where none does (rounding, or nothing left over), the last one
        at = F.struct("_b", (F.col("_run") - F.col("_n")).alias("below"))
        pick = run.groupBy("_s").agg(F.coalesce(F.min(F.when(F.col("_run") > F.col("_left"), at)), F.max(at)).alias("_x"))
        next_ = state.join(small(pick), "_s", "left").select("_s", "total", "target", "_copies", (F.col("_left") - F.coalesce("_x.below", F.lit(0))).alias("_left"), F.coalesce("_x._b", F.col("_cut")).alias("_cut"))
        state = staged(next_, "mix")
    edge = rows.where(F.col("size") > 0).join(small(state.select("_s", "_cut")), "_s").where(F.col("_h") == F.col("_cut")).groupBy("_s").agg(F.sum("size").alias("_e"))
    nearer = F.coalesce("_e", F.lit(0)) <= 2 * F.col("_left")
    done = staged(state.join(small(edge), "_s", "left").select("_s", F.col("total").alias("source_size"), "target", "_copies", "_cut", nearer.alias("_edge")), "mix")
    return small(done)


def _times(most: float) -> Column:
    more = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & F.col("_edge"))
    return F.least(F.col("_copies") + more.cast("int"), F.lit(int(most)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, _s, _h, size, source_size, target and taken, one row for each row of `docs`."""
    rows = staged(measured(docs), "mix")
    at = rows.join(planned(rows, weights, share, most), "_s")
    return at.withColumn("taken", F.col("size") * _times(most)).drop("_copies", "_cut", "_edge")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`docs` with each document as often as the mix takes it."""
    plan = planned(staged(measured(docs), "mix"), weights, share, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # so that no column of the documents clashes
    keyed = docs.select(whole, _source().alias("_s"), _hash().alias("_h"))
    out = keyed.join(plan, "_s").withColumn("_t", _times(most)).where(F.col("_t") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).select("_row.*")
