"""Window frames over long series without a task for each series.

A series may be a third of all rows, so frames of bounded reach are dealt by (series, chunk of the order column), with the
rows a neighbouring chunk needs copied there. Frames that reach back without bound are split in two: within the chunk, and
a carry over chunk summaries, of which there are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec


def framed(df: DataFrame, order: str, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], by: str = "series", width: int | None = None) -> DataFrame:
    """`df` with columns over the rows within [order - before, order + after]; `columns` gets the ordered window.

    The frame of a column is whatever it sets with rangeBetween inside that reach. Rows with a null order are dropped.
    """
    width = width or max(1, 8 * (before + after + 1))
    copies = F.sequence(F.floor((F.col(order) - after) / width), F.floor((F.col(order) + before) / width))
    dealt = df.where(F.col(order).isNotNull()).withColumn("_chunk", F.explode(copies))
    w = W.partitionBy(by, "_chunk").orderBy(order)
    out = dealt.withColumns(columns(w))
    return out.where(F.col("_chunk") == F.floor(F.col(order) / width)).drop("_chunk")


def carried(df: DataFrame, order: list[Column], value: Column, name: str, chunk: Column, by: str = "series", last: bool = True) -> DataFrame:
    """`df` with the last non-null `value` at or before each row (at or after it where `last` is False).

    `chunk` must not decrease in `order` within a series.
    """
    rows = df.withColumn("_v", value).withColumn("_c", chunk)
    keys = [c.asc() if last else c.desc() for c in order]
    inside = F.last("_v", True).over(W.partitionBy(by, "_c").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
    ends = rows.where(F.col("_v").isNotNull()).groupBy(by, "_c").agg((F.max_by if last else F.min_by)("_v", F.struct(*order)).alias("_end"))
    spine = rows.select(by, "_c").distinct().join(ends, [by, "_c"], "left")
    over = W.partitionBy(by).orderBy(F.col("_c").asc() if last else F.col("_c").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = spine.select(by, "_c", F.last("_end", True).over(over).alias("_carry"))
    return rows.withColumn("_in", inside).join(before, [by, "_c"]).withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_c", "_in", "_carry")


def running(df: DataFrame, order: list[Column], value: Column, name: str, chunk: Column, by: str = "series", how: str = "sum", strict: bool = False) -> DataFrame:
    """`df` with the running sum or max of `value` up to and including each row (`strict`: before it), in two levels."""
    f = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_v", value).withColumn("_c", chunk)
    inside = f("_v").over(W.partitionBy(by, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0))
    totals = rows.groupBy(by, "_c").agg(f("_v").alias("_t"))
    before = totals.select(by, "_c", f("_t").over(W.partitionBy(by).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    both = F.coalesce(F.col("_in"), F.lit(0)) + F.coalesce("_carry", F.lit(0)) if how == "sum" else F.greatest("_in", "_carry")
    return rows.withColumn("_in", inside).join(before, [by, "_c"]).withColumn(name, both).drop("_v", "_c", "_in", "_carry")


def runs(df: DataFrame, k: str, on: Column, gap: int = 1, by: str = "series", chunk: int = 4096) -> DataFrame:
    """Rows where `on` holds, numbered by run: `run` grows where two are more than `gap` apart in the integer column `k`."""
    rows = df.where(on)
    # the place of the row before: within the chunk, else the last of the chunks before
    placed = rows.withColumn("_c", F.floor(F.col(k) / chunk))
    inside = F.lag(k).over(W.partitionBy(by, "_c").orderBy(k))
    ends = placed.groupBy(by, "_c").agg(F.max(k).alias("_e"))
    before = ends.select(by, "_c", F.lag("_e").over(W.partitionBy(by).orderBy("_c")).alias("_p"))
    marked = placed.withColumn("_i", inside).join(before, [by, "_c"]).withColumn("_i", F.coalesce("_i", "_p"))
    first = F.when(F.col("_i").isNull() | (F.col(k) - F.col("_i") > gap), 1).otherwise(0)
    return running(marked.drop("_c", "_p").withColumn("_f", first).drop("_i"), [F.col(k)], F.col("_f"), "run", F.floor(F.col(k) / chunk), by).drop("_f")
