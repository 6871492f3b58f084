"""Spectral helpers, samples and controls, comparisons of two arms, incremental intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import scalars
from gapline.operators import labels, physics
from gapline.sources import tables
from gapline.streaming import events as stream

from .base import E_SQL, a_sql, active, binned, rounded, samples
from .registry import query

_M = 2147483647
#: A number in [0, 1) from an id: three steps of a multiplicative generator.
_U = f"(((id % {_M} + 1) * 48271 % {_M}) * 48271 % {_M}) * 48271 % {_M} / {float(_M)}"


@query(f"""WITH {E_SQL}, h AS (SELECT series, t // 3600 AS hour, sum(x) FILTER (x >= 50) AS hi, sum(x) FILTER (x < 50) AS lo FROM e GROUP BY ALL)
SELECT series, hour, round(CASE WHEN lo >= 10 THEN hi / lo END, 9) + 0.0 AS hardness FROM h""")
def hardness_ratio(spark, sf_dir):
    e = samples(spark, sf_dir).groupBy("series", F.floor(F.col("t") / 3600).alias("hour")).agg(F.sum(F.when(F.col("x") >= 50, F.col("x"))).alias("hi"), F.sum(F.when(F.col("x") < 50, F.col("x"))).alias("lo"))
    return rounded(e.select("series", "hour", scalars.hardness([F.col("hi")], [F.col("lo")], 10.0).alias("hardness")))


@query(f"""WITH {E_SQL}, b AS (SELECT series, floor(x / 20)::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT series, min(bin) FILTER (n - 2.0 < 3 * sqrt(2.0)) AS f FROM b GROUP BY series)
SELECT b.series, bin, n FROM b JOIN f USING (series) WHERE f IS NULL OR bin < f""")
def fit_range(spark, sf_dir):
    b = samples(spark, sf_dir).groupBy("series", F.floor(F.col("x") / 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return physics.fit_range(b.withColumn("bkg", F.lit(2.0))).drop("bkg")


@query(f"""WITH {E_SQL}, s AS (SELECT series, floor(x / 5) * 5 AS energy, count(*) AS counts FROM e WHERE x < 105 AND x >= 20 GROUP BY ALL), m AS (SELECT series, quantile_cont(counts, 0.5) AS m FROM s WHERE energy BETWEEN 20 AND 100 GROUP BY series)
SELECT series, round(sum(greatest(counts - m, 0) * energy) / nullif(sum(greatest(counts - m, 0)), 0), 9) + 0.0 AS centroid, round(sum(greatest(counts - m, 0)), 9) + 0.0 AS excess FROM s JOIN m USING (series) WHERE energy BETWEEN 20 AND 100 GROUP BY series""")
def line_centroid(spark, sf_dir):
    s = samples(spark, sf_dir).groupBy("series", (F.floor(F.col("x") / 5) * 5).cast("double").alias("energy")).agg(F.count(F.lit(1)).cast("double").alias("counts"))
    return rounded(physics.line_centroid(s, 20.0, 100.0))


@query(f"""WITH {E_SQL}, g AS (SELECT t // 3600 AS k, avg(x) FILTER (series = 'click') AS x, avg(x) FILTER (series = 'error') AS y FROM e GROUP BY ALL),
c AS (SELECT l.lag, round(corr(a.x, b.y), 12) AS r FROM g a, (SELECT unnest(range(-5, 6)) AS lag) l, g b WHERE b.k = a.k + l.lag GROUP BY 1),
p AS (SELECT lag, r, lag(r) OVER (ORDER BY lag) AS a, lead(r) OVER (ORDER BY lag) AS c FROM c), t AS (SELECT * FROM p ORDER BY r DESC, lag LIMIT 1)
SELECT 'pair' AS series, round(lag + CASE WHEN a - 2 * r + c < 0 THEN 0.5 * (a - c) / (a - 2 * r + c) ELSE 0 END, 6) + 0.0 AS lag FROM t""")
def refined_lag(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy(F.floor(F.col("t") / 3600).alias("k")).agg(F.avg(F.when(F.col("series") == "click", F.col("x"))).alias("x"), F.avg(F.when(F.col("series") == "error", F.col("x"))).alias("y"))
    lags = g.select("k", "x").withColumn("lag", F.explode(F.sequence(F.lit(-5), F.lit(5)))).withColumn("k2", F.col("k") + F.col("lag"))
    r = lags.join(g.select(F.col("k").alias("k2"), "y"), "k2").groupBy("lag").agg(F.round(F.corr("x", "y"), 12).alias("r")).withColumn("series", F.lit("pair"))
    return physics.refined_lag(r).select("series", (F.round("lag", 6) + 0.0).alias("lag"))


@query(f"WITH {E_SQL} SELECT id, series FROM e WHERE {_U} < 0.2")
def hash_sample(spark, sf_dir):
    return labels.sample(samples(spark, sf_dir), "id", 0.2).select("id", "series")


@query(f"""WITH {E_SQL}, v AS (SELECT * FROM e WHERE x >= 120), c AS (SELECT series, id, t + floor({_U} * 2 * 21600)::BIGINT - 21600 AS t FROM v)
SELECT series, id, t FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.series = c.series AND abs(v.t - c.t) < 1800)""")
def control_times(spark, sf_dir):
    return labels.control_times(samples(spark, sf_dir).where("x >= 120").select("series", "id", "t"), "id", 21600, 1800, 86400)


@query(f"WITH {a_sql()}, m AS (SELECT (a.peak_value >= 100)::INT AS cls, a.event, a.series, avg(h.x) AS m FROM a JOIN h ON h.series = a.series AND h.k BETWEEN a.start - 3 AND a.stop AND h.x IS NOT NULL GROUP BY ALL) SELECT cls, round(avg(m), 9) + 0.0 AS mean, count(*) AS events FROM m GROUP BY cls")
def event_climatology(spark, sf_dir):
    from gapline.operators import temporal

    a = active(spark, sf_dir)
    s = temporal.slices(a.select("series", "event", "start", "stop"), binned(spark, sf_dir, 3600), 3, 0, 64, "k")
    rows = s.join(a.select("series", "event", (F.col("peak_value") >= 100).cast("int").alias("cls")), ["series", "event"])
    return rounded(labels.climatology(rows.withColumn("event", F.struct("series", "event")), "x", "event", "cls"))


@query(f"""WITH {E_SQL}, a AS (SELECT t // 3600 AS k, avg(x) AS x FROM e WHERE series = 'click' GROUP BY 1), b AS (SELECT t // 3600 AS k, avg(x) AS x FROM e WHERE series = 'view' GROUP BY 1)
SELECT a.k // 24 AS day, round(avg(a.x - b.x), 9) + 0.0 AS gain, count(*) AS pairs FROM a JOIN b USING (k) GROUP BY 1""")
def paired_gain(spark, sf_dir):
    h = binned(spark, sf_dir, 3600).where("x IS NOT NULL").withColumn("day", F.floor(F.col("k") / 24))
    return rounded(labels.paired(h.where("series = 'click'"), h.where("series = 'view'"), ["k"], "x", "day"))


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""")
def pending_sources(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    manifest = o.where("o_orderstatus = 'F'").select("key", F.lit("ok").alias("status"))
    return tables.pending(o, manifest).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E_SQL}, o AS (SELECT DISTINCT series, t // 86400 * 86400 AS t FROM e), l AS (SELECT series, max(t) AS last FROM e GROUP BY 1) SELECT series, o.t, NOT (o.t + 3600 + 7200 <= last) AS pending FROM o JOIN l USING (series)""")
def settled_forecasts(spark, sf_dir):
    e = samples(spark, sf_dir)
    origins = e.select("series", (F.floor(F.col("t") / 86400) * 86400).alias("t")).distinct()
    return stream.settled(origins, e.groupBy("series").agg(F.max("t").alias("last")), 3600, 7200)
