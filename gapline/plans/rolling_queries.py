"""Rolling-origin forecasts of the peaks of active runs, from what is known when they begin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gapline.operators import metrics, quantiles, rolling, walks

from .base import a_sql, active, binned
from .registry import query

FOLDS, LEAST = 5, 10

#: Events with the level at their start and the peak before (null beyond a day), in five blocks of each series; forecasts by closed forms.
_SQL = f"""WITH {a_sql()}, v AS (
  SELECT a.series, a.event, a.start, a.peak_value AS y, h.x AS level, CASE WHEN a.start - lag(a.stop) OVER w <= 24 THEN lag(a.peak_value) OVER w END AS previous, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.series) AS n
  FROM a JOIN h ON h.series = a.series AND h.k = a.start WINDOW w AS (PARTITION BY a.series ORDER BY a.start)
), b AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS block FROM v),
f AS (
  SELECT q.series, q.block, regr_slope(t.y, t.level) AS s1, regr_intercept(t.y, t.level) AS c1, avg(t.y) AS m, avg(t.y) FILTER (t.previous IS NOT NULL) AS my, avg(t.previous) AS mp, coalesce(regr_slope(t.y, t.previous), 0) AS s2, avg(t.y) FILTER (t.previous IS NULL) AS m0,
    avg((t.y >= 85)::INT) AS em, regr_slope((t.y >= 85)::INT, t.level) AS e1, regr_intercept((t.y >= 85)::INT, t.level) AS d1, coalesce(regr_slope((t.y >= 85)::INT, t.previous), 0) AS e2, avg((t.y >= 85)::INT) FILTER (t.previous IS NOT NULL) AS ey, avg((t.y >= 85)::INT) FILTER (t.previous IS NULL) AS e0
  FROM (SELECT DISTINCT series, block FROM b) q JOIN b t ON t.series = q.series AND t.block < q.block GROUP BY ALL HAVING count(*) >= {LEAST}
), p AS (
  SELECT b.*, coalesce(c1 + s1 * level, m) AS by_level, CASE WHEN previous IS NULL THEN coalesce(m0, m) ELSE coalesce(my + s2 * (previous - mp), m) END AS by_previous,
    coalesce(d1 + e1 * level, em) AS e_level, CASE WHEN previous IS NULL THEN coalesce(e0, em) ELSE coalesce(ey + e2 * (previous - mp), em) END AS e_previous,
    (SELECT quantile_cont(z.y, 0.5) FROM b z WHERE z.series = b.series AND z.block = 0) AS first_median
  FROM b LEFT JOIN f USING (series, block))"""


def _events(spark, sf_dir):
    a = active(spark, sf_dir)
    hours = binned(spark, sf_dir, 3600).select("series", F.col("k").alias("start"), F.col("x").alias("level"))
    w = W.partitionBy("series", F.lit(0)).orderBy("start")  # runs, of which a series has few
    before = F.when(F.col("start") - F.lag("stop").over(w) <= 24, F.lag("peak_value").over(w))
    rows = a.withColumn("previous", before).join(hours, ["series", "start"])
    return walks.written(rolling.blocks(rows.select("series", "event", "start", F.col("peak_value").alias("y"), "level", "previous"), FOLDS, "start"), "blocks")


@query(_SQL + """ SELECT forecast, count(*) AS n, round(avg(e), 6) + 0.0 AS mae FROM (SELECT unnest(['by_level', 'by_previous', 'first_median', 'level']) AS forecast, unnest([abs(by_level - y), abs(by_previous - y), abs(first_median - y), abs(level - y)]) AS e FROM p WHERE block > 0) WHERE e IS NOT NULL GROUP BY forecast""")
def rolling_forecast(spark, sf_dir):
    rows = _events(spark, sf_dir)
    for name in ("level", "previous"):
        rows = rolling.rolling_forecast(rows, [name], "y", FOLDS, LEAST, name=f"by_{name}")
    first = quantiles.quantiles(rows.where("block = 0"), ["series"], {"first_median": (F.col("y"), 0.5)})
    out = rolling.error_summary(rows.where("block > 0").join(first, "series", "left"), "y", ["by_level", "by_previous", "first_median", "level"])
    return out.select("forecast", "n", (F.round("mae", 6) + 0.0).alias("mae"))


_AUC = """SELECT '{0}' AS forecast, sum(hit) AS positives, sum(1 - hit) AS negatives, round((sum(r * hit) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * sum(1 - hit)), 6) + 0.0 AS auc
FROM (SELECT (y >= 85)::INT AS hit, rank() OVER (ORDER BY round({0}, 9)) + (count(*) OVER (PARTITION BY round({0}, 9)) - 1) / 2.0 AS r FROM p WHERE block > 0 AND {0} IS NOT NULL)"""


@query(_SQL + " " + " UNION ALL ".join(_AUC.format(c) for c in ("e_level", "e_previous")))
def rolling_exceedance(spark, sf_dir):
    rows, out = _events(spark, sf_dir).withColumn("hit", (F.col("y") >= 85).cast("int")), None
    for name in ("level", "previous"):
        got = rolling.rolling_forecast(rows, [name], "hit", FOLDS, LEAST, name="p").where("block > 0").withColumn("p", F.round("p", 9))
        one = metrics.roc_auc(got, "hit", "p").select(F.lit(f"e_{name}").alias("forecast"), "positives", "negatives", (F.round("auc", 6) + 0.0).alias("auc"))
        out = one if out is None else out.union(one)
    return out
