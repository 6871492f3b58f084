"""Verification metrics and calibration over score and label pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import calibrate, metrics, temporal
from gapline.sources.tables import table

from .base import E_SQL, S_SQL, active, a_sql, b_sql, binned, r_sql, rounded, samples, scores
from .registry import query

_SKILL = """round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) + 0.0 AS tss,
  round(CASE WHEN (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) > 0 THEN 2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) ELSE 0 END, 9) + 0.0 AS hss,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) + 0.0 AS f1"""


@query(f"""WITH {S_SQL}, c AS (SELECT source, count(*) FILTER (y = 1 AND p >= 0.4) AS tp, count(*) FILTER (y = 0 AND p >= 0.4) AS fp, count(*) FILTER (y = 1 AND p < 0.4) AS fn, count(*) FILTER (y = 0 AND p < 0.4) AS tn FROM s GROUP BY source)
SELECT source, tp, fp, fn, tn, {_SKILL} FROM c""")
def contingency_scores(spark, sf_dir):
    out = metrics.contingency(scores(spark, sf_dir), F.col("y") == 1, F.col("p") >= 0.4, ["source"])
    return rounded(out.select("source", "tp", "fp", "fn", "tn", "tss", "hss", "f1"))


@query(f"""WITH {S_SQL}, c AS (SELECT p AS threshold, sum(y) AS a, count(*) AS n FROM s GROUP BY 1), r AS (SELECT threshold, sum(a) OVER w AS tp, sum(n) OVER w - sum(a) OVER w AS fp, sum(a) OVER () - sum(a) OVER w AS fn, sum(n) OVER () - sum(a) OVER () - sum(n) OVER w + sum(a) OVER w AS tn FROM c WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_SKILL} FROM r ORDER BY round(tp / (tp + fn) - fp / (fp + tn), 12) DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(scores(spark, sf_dir), "y", "p").select("threshold", "tp", "fp", "fn", "tn", "tss", "hss", "f1"))


@query(f"WITH {S_SQL}, b AS (SELECT lang, avg(power(p - y, 2)) AS brier, avg(y) * (1 - avg(y)) AS reference, count(*) AS n FROM s GROUP BY lang) SELECT lang, n, {r_sql('brier', 'reference')}, round(CASE WHEN reference > 0 THEN 1 - brier / reference END, 9) + 0.0 AS skill FROM b")
def brier_skill(spark, sf_dir):
    return rounded(metrics.brier(scores(spark, sf_dir), "y", "p", ["lang"]))


@query(f"""WITH {S_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s), a AS (SELECT sum(r) FILTER (y = 1) AS s, sum(y) AS a, count(*) - sum(y) AS b FROM r)
SELECT round((s - a * (a + 1) / 2) / (a * b), 9) + 0.0 AS auc, a::BIGINT AS positives, b::BIGINT AS negatives FROM a""")
def roc_auc_ties(spark, sf_dir):
    return rounded(metrics.roc_auc(scores(spark, sf_dir), "y", "p"))


@query(f"WITH {S_SQL}, r AS (SELECT least(9, floor(p * 10))::BIGINT AS bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM s GROUP BY 1) SELECT bin, {r_sql('mean_p', 'mean_y')}, n, round((bin + 0.5) / 10, 9) + 0.0 AS centre FROM r")
def reliability(spark, sf_dir):
    out = metrics.reliability(scores(spark, sf_dir), "y", "p")
    return rounded(out.withColumn("bin", F.col("bin").cast("long")))


@query(f"""WITH {S_SQL}, v AS (SELECT least(2, y + toxic) AS y, least(2, floor(p * 3))::INT AS z FROM s), c AS (SELECT cls, sum(t)::BIGINT AS n_true, sum(q)::BIGINT AS n_pred, sum(r)::BIGINT AS n_right FROM (SELECT y AS cls, 1 AS t, 0 AS q, (y = z)::INT AS r FROM v UNION ALL SELECT z, 0, 1, 0 FROM v) GROUP BY cls)
SELECT cls, n_true, n_pred, n_right, round(CASE WHEN n_pred > 0 THEN n_right / n_pred ELSE 0 END, 9) + 0.0 AS precision, round(CASE WHEN n_true > 0 THEN n_right / n_true ELSE 0 END, 9) + 0.0 AS recall, round(2.0 * n_right / (n_true + n_pred), 9) + 0.0 AS f1 FROM c""")
def confusion_matrix(spark, sf_dir):
    s = scores(spark, sf_dir).select(F.least(F.lit(2), F.col("y") + F.col("toxic")).alias("y"), F.least(F.lit(2), F.floor(F.col("p") * 3)).cast("int").alias("z"))
    return rounded(metrics.confusion(s, "y", "z"))


_RV = f"""{b_sql()}, v AS (SELECT series, x AS y, lag(x) OVER w AS z, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS r FROM b WINDOW w AS (PARTITION BY series ORDER BY k))"""


@query(f"""WITH {_RV}, a AS (SELECT series, avg(abs(r - y)) AS mae, sqrt(avg(power(r - y, 2))) AS rmse, avg(r - y) AS bias, count(*) AS n, var_pop(y) AS v, sqrt(avg(power(z - y, 2))) AS ref FROM v WHERE y IS NOT NULL AND z IS NOT NULL AND r IS NOT NULL GROUP BY series)
SELECT series, {r_sql('mae', 'rmse', 'bias')}, n, round(1 - rmse * rmse / v, 9) + 0.0 AS r2, round(1 - rmse / ref, 9) + 0.0 AS skill FROM a""")
def regression_scores(spark, sf_dir):
    from gapline.operators import frames

    v = frames.framed(binned(spark, sf_dir), "k", 12, 0, lambda w: {"z": F.first("x").over(w.rangeBetween(-1, -1)), "r": F.avg("x").over(w.rangeBetween(-12, -1))})
    return rounded(metrics.regression(v.withColumnRenamed("x", "y"), "y", "r", "z", ["series"]))


@query(f"""WITH {_RV} SELECT series, round(avg((y BETWEEN 0.3 * r AND 2.5 * r)::INT), 9) + 0.0 AS inside, round(corr(y, r), 9) + 0.0 AS r, round(stddev_pop(r) / stddev_pop(y), 9) + 0.0 AS spread, count(*) AS n FROM v WHERE y IS NOT NULL AND r IS NOT NULL GROUP BY series""")
def interval_coverage(spark, sf_dir):
    from gapline.operators import frames

    v = frames.framed(binned(spark, sf_dir), "k", 12, 0, lambda w: {"mid": F.avg("x").over(w.rangeBetween(-12, -1))})
    rows = v.select("series", F.col("x").alias("y"), "mid", (0.3 * F.col("mid")).alias("low"), (2.5 * F.col("mid")).alias("high"))
    return rounded(metrics.interval_coverage(rows, "y", "low", "mid", "high", ["series"]))


@query(f"""WITH {_RV} SELECT series, round(avg(greatest(0.5 * (y - z), -0.5 * (y - z))), 9) + 0.0 AS pinball_z, round(avg(greatest(0.9 * (y - r), -0.1 * (y - r))), 9) + 0.0 AS pinball_r, round(avg(CASE WHEN abs(y - z) <= 1 THEN 0.5 * power(y - z, 2) ELSE abs(y - z) - 0.5 END), 9) + 0.0 AS huber
FROM v WHERE y IS NOT NULL AND z IS NOT NULL AND r IS NOT NULL GROUP BY series""")
def quantile_losses(spark, sf_dir):
    from gapline.operators import frames

    v = frames.framed(binned(spark, sf_dir), "k", 12, 0, lambda w: {"z": F.first("x").over(w.rangeBetween(-1, -1)), "r": F.avg("x").over(w.rangeBetween(-12, -1))})
    rows = v.withColumnRenamed("x", "y").where("y IS NOT NULL AND z IS NOT NULL AND r IS NOT NULL")
    return rounded(metrics.quantile_loss(rows, "y", {"z": 0.5, "r": 0.9}, ["series"]))


@query(f"""WITH {a_sql()}, g AS (SELECT series AS gs, k FROM h WHERE x >= 75), f AS (SELECT a.event, CASE WHEN a.peak_value >= 100 THEN 'M' ELSE 'C' END AS cls, s.shift, EXISTS (SELECT 1 FROM g WHERE gs = a.series AND k BETWEEN a.start + s.shift - 1 AND a.stop + s.shift) AS found FROM a, (SELECT unnest([0, -24, 24]) AS shift) s),
r AS (SELECT cls, count(*) FILTER (shift = 0) AS n, avg(found::INT) FILTER (shift = 0) AS recall, avg(found::INT) FILTER (shift <> 0) AS chance FROM f GROUP BY cls)
SELECT cls, n, {r_sql('recall', 'chance')}, round(recall - chance, 9) + 0.0 AS above_chance FROM r""")
def recall_by_class_with_chance(spark, sf_dir):
    h = binned(spark, sf_dir, 3600).where("x >= 75").select("series", F.col("k").alias("start"), F.col("k").alias("stop"))
    a = active(spark, sf_dir).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(-24), F.lit(24))))
    moved = a.select("series", "event", F.when(F.col("peak_value") >= 100, "M").otherwise("C").alias("cls"), "shift", (F.col("start") + F.col("shift") - 1).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"))
    return rounded(metrics.recall_by_class(temporal.overlapping(moved, h, 64).withColumnRenamed("overlaps", "found")))


@query("""WITH o AS (SELECT o_totalprice AS x, (o_orderstatus = 'F')::INT AS f FROM orders), g AS (SELECT unnest(list_filter(['B', 'C', 'M'], lambda c: x >= CASE c WHEN 'B' THEN 1000 WHEN 'C' THEN 100000 ELSE 300000 END)) AS floor, f FROM o)
SELECT floor, count(*) AS n, round(avg(f), 9) + 0.0 AS mean FROM g GROUP BY floor""")
def floor_grouping(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(metrics.floors(o, "o_totalprice", {"B": 1000, "C": 100000, "M": 300000}, (F.col("o_orderstatus") == "F").cast("int")))


@query(f"""WITH {E_SQL}, v AS (SELECT series, floor(x / 10) AS a, "user" AS b FROM e), r AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY a) + (count(*) OVER (PARTITION BY series, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY series ORDER BY b) + (count(*) OVER (PARTITION BY series, b) - 1) / 2.0 AS rb FROM v)
SELECT series, round(corr(ra, rb), 9) + 0.0 AS rho, count(*) AS n FROM r GROUP BY series""")
def spearman(spark, sf_dir):
    v = samples(spark, sf_dir).select("series", F.floor(F.col("x") / 10).alias("a"), F.col("user").alias("b"))
    return rounded(metrics.spearman(v, "a", "b"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(least(greatest(sum(n) OVER () / (count(*) OVER () * n), 0.2), 10.0), 9) + 0.0 AS weight FROM c")
def class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(table(spark, sf_dir, "documents").select("lang"), "lang"))


_PX = "SELECT log10(l_quantity * 10) AS x, log10(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0"


@query(f"""WITH p AS ({_PX}), b AS (SELECT floor(x / 0.2) AS b, count(*) AS n, quantile_cont(x, 0.5) AS kx, quantile_cont(y, 0.5) AS ky FROM p GROUP BY 1 HAVING count(*) >= 20)
SELECT round(kx, 9) + 0.0 AS x, round(max(ky) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS y, n FROM b""")
def piecewise_calibration_fit(spark, sf_dir):
    return rounded(calibrate.piecewise_fit(_points(spark, sf_dir), "x", "y", 0.2, 20))


def _points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0 AND l_quantity > 0")
    return li.select("l_orderkey", "l_linenumber", F.log10(F.col("l_quantity") * 10).alias("x"), F.log10("l_extendedprice").alias("y"))


@query(f"""WITH p AS ({_PX}), b AS (SELECT floor(x / 0.2) AS b, count(*) AS n, quantile_cont(x, 0.5) AS kx, quantile_cont(y, 0.5) AS ky FROM p GROUP BY 1 HAVING count(*) >= 20),
k AS (SELECT kx, max(ky) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS ky, row_number() OVER (ORDER BY b) AS i FROM b), s AS (SELECT a.i, a.kx AS x0, a.ky AS y0, c.kx AS x1, c.ky AS y1, max(a.i) OVER () AS last FROM k a JOIN k c ON c.i = a.i + 1),
q AS (SELECT DISTINCT l_quantity AS v, log10(l_quantity * 10) AS x FROM lineitem WHERE l_quantity > 0)
SELECT v, round(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)), 9) + 0.0 AS calibrated FROM q JOIN s ON (x < x1 OR i = last) AND (x >= x0 OR i = 1)""")
def piecewise_calibration_apply(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_quantity").alias("v")).distinct().withColumn("x", F.log10(F.col("v") * 10))
    knots = calibrate.piecewise_fit(_points(spark, sf_dir), "x", "y", 0.2, 20)
    return rounded(calibrate.piecewise_apply(q, knots, "x").select("v", "calibrated"), "v")


@query("""WITH p AS (SELECT log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0)
SELECT count(*) AS n, round(regr_slope(y, x), 9) + 0.0 AS slope, round(regr_intercept(y, x), 9) + 0.0 AS intercept, round(sqrt(var_pop(y) * (1 - corr(y, x) * corr(y, x))), 9) + 0.0 AS scatter FROM p""")
def flux_anchor_ols(spark, sf_dir):
    return rounded(calibrate.anchor(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 100))


@query(f"""WITH {S_SQL}, g AS (SELECT p AS x, sum(y) AS s, count(*) AS w FROM s WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1), c AS (SELECT x, sum(s) OVER (ORDER BY x) AS cs, sum(s) OVER (ORDER BY x) - s AS bs, sum(w) OVER (ORDER BY x) AS cw, sum(w) OVER (ORDER BY x) - w AS bw FROM g),
m AS (SELECT a.x AS lo, b.x AS hi, (b.cs - a.bs) / (b.cw - a.bw) AS mean FROM c a JOIN c b ON a.x <= b.x), i AS (SELECT x, (SELECT max(v) FROM (SELECT min(mean) AS v FROM m WHERE lo <= c.x AND hi >= c.x GROUP BY lo)) AS v FROM c)
SELECT doc_id, p, round(least(greatest(round(v, 6), 0), 1), 6) + 0.0 AS calibrated FROM s JOIN i ON i.x = s.p""")
def isotonic_calibration(spark, sf_dir):
    s = scores(spark, sf_dir)
    out = calibrate.probability(s, calibrate.isotonic(s, "p", "y"), "p")
    return out.select("doc_id", "p", (F.round("calibrated", 6) + 0.0).alias("calibrated"))


@query(None)
def cluster_bootstrap(spark, sf_dir):
    return rounded(metrics.cluster_bootstrap(samples(spark, sf_dir), "x", "user"))
