"""Exact quantiles of groups of any size, by refining the histogram around the ranks that are asked for.

The rows of a group are counted in buckets between its least and greatest value. Only the bucket that holds a wanted rank is
looked into further, between its own least and greatest value, until that bucket holds one value. So what an aggregate holds
is a number for each bucket, not the values. Groups up to a bounded size take Spark's own exact percentile, with the same
result. Between two ranks values are interpolated linearly; nulls are left out; NaN is the greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .walks import written

#: Rows up to which a group's values may stand in one aggregate, and buckets of a histogram.
SMALL, BUCKETS = 100_000, 4096


def _bucket(x: str, low: str, high: str, n: int) -> Column:
    """Rises with x; the least value is in the first bucket and the greatest in the last one. Halves, so that no span overflows."""
    share = (F.col(x) / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2)
    inside = F.when(F.col(high) > F.col(low), F.least(F.floor(share * n), F.lit(n - 1))).otherwise(0)
    return F.when(F.isnan(x), n + 1).when(F.col(x) == float("inf"), n).when(F.col(x) == float("-inf"), -1).otherwise(inside)


def _refined(rows: DataFrame, wanted: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """key, rank and value of the wanted ranks (key, rank) among the x of `rows`."""
    finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    spans = rows.groupBy(*key).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    open_ = written(wanted.join(spans, key).select(*key, "rank", F.col("rank").alias("_left"), "_low", "_high"), "ranks")
    found = None
    while True:
        span = [*key, "_low", "_high"]
        ranges = open_.select(*span).distinct()
        inside = rows.join(ranges, key).where((F.col("x").between(F.col("_low"), F.col("_high"))) | F.col("_low").isNull() if found is not None else F.lit(True))
        counts = inside.groupBy(*span, _bucket("x", "_low", "_high", buckets).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"))
        upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*span).orderBy("_b")))
        same = F.col("_left").between(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)
        terms = [F.col(f"o.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("_low", "_high")]
        on = [F.col(f"o.{c}") == F.col(f"u.{c}") for c in key]
        met = open_.alias("o").join(upto.alias("u"), [*on, *terms]).where(same)
        met = written(met.select(*[F.col(f"o.{c}") for c in key], "rank", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_min").alias("_low"), F.col("_max").alias("_high")), "ranks")
        done = met.where(F.col("_low").eqNullSafe(F.col("_high"))).select(*key, "rank", F.col("_low").alias("value"))
        found = done if found is None else found.union(done)
        open_ = met.where(~F.col("_low").eqNullSafe(F.col("_high")))
        if open_.isEmpty():
            return found


def quantiles(df: DataFrame, by: list[str], asked: dict[str, tuple[Column, float]], also: list[Column] | None = None, small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """A row for each group of `by`: the aggregates `also`, and the quantile of a column's values for each name in `asked`, null
    where there is no value.

    Without `by` there is one row, for an empty table as well. `small` bounds the values in an aggregate; it changes no result.
    """
    keys = {c: f"_g{i}" for i, c in enumerate(by)}
    columns: list[str] = []
    at: dict[str, int] = {}
    values: list[Column] = []
    for name, (x, _) in asked.items():  # a column that is asked for twice is looked at once
        text = str(x)
        if text not in columns:
            columns.append(text)
            values.append(x.cast("double"))
        at[name] = columns.index(text)
    group = F.struct(*[F.col(c).alias(k) for c, k in keys.items()], F.lit(0).alias("_one"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(values)]))
    rows = df.select(F.to_json(group).alias("g"), cells.alias("_c")).select("g", "_c.i", "_c.x").where(F.col("x").isNotNull())
    sizes = rows.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "sizes")
    few = sizes.where(F.col("n") <= small)
    shares = sorted({q for _, q in asked.values()})
    exact = rows.join(few, ["g", "i"]).groupBy("g", "i").agg(F.percentile("x", F.array(*[F.lit(float(q)) for q in shares])).alias("_q"))
    found = exact.select("g", "i", F.posexplode("_q").alias("_p", "value"))
    many = sizes.where(F.col("n") > small)
    if not many.isEmpty():
        rows = written(rows.join(many, ["g", "i"], "left_semi"), "values")
        place = F.col("_share") * (F.col("n") - 1)
        asks = many.select("g", "i", "n", F.posexplode(F.array(*[F.lit(float(q)) for q in shares])).alias("_p", "_share")).withColumn("_at", place)
        ends = asks.select("g", "i", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("rank")).distinct()
        ranked = written(_refined(rows, ends, ["g", "i"], buckets), "ranked")
        low, high = (ranked.select("g", "i", F.col("rank").alias(f"_{n}"), F.col("value").alias(f"_{n}v")) for n in ("low", "high"))
        both = asks.withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at")).join(low, ["g", "i", "_low"]).join(high, ["g", "i", "_high"])
        between = F.when(F.col("_low") == F.col("_high"), F.col("_lowv")).when(F.col("_lowv") == F.col("_highv"), F.col("_lowv"))
        between = between.otherwise((F.col("_high") - F.col("_at")) * F.col("_lowv") + (F.col("_at") - F.col("_low")) * F.col("_highv"))
        found = found.union(both.select("g", "i", "_p", between.alias("value")))
    pick = lambda name: F.max(F.when((F.col("i") == at[name]) & (F.col("_p") == shares.index(asked[name][1])), F.col("value"))).alias(name)
    out = found.groupBy("g").agg(*[pick(n) for n in asked])
    if by:
        groups = df.groupBy(*by).agg(*also) if also else df.select(*by).distinct()
    else:
        groups = df.agg(*(also or [F.lit(0).alias("_none")]))
    keyed = groups.withColumn("g", F.to_json(group)).join(out, "g", "left").drop("g")
    return keyed if by or also else keyed.drop("_none")
