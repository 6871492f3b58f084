"""Window features over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import activity, alerts, detect, frames, labels, windows

from .base import DIGITS, E_SQL, b_sql, binned, r_sql, rounded, samples
from .registry import query

B = b_sql()


def _bx(columns: str, extra: str = "") -> str:
    return f"SELECT series, k, {columns} FROM b {extra}"


@query(f"""WITH {B}, f AS (SELECT series, min(k) AS a, arg_min(k, k) AS k0 FROM b GROUP BY series), p AS (
  SELECT series, k, x, true AS own FROM b UNION ALL
  SELECT f.series, unnest(range(a - 35, a)) AS k, (SELECT x FROM b WHERE b.series = f.series AND b.k = a) AS x, false FROM f)
SELECT series, k, round(percentile, {DIGITS}) + 0.0 AS percentile FROM (
  SELECT series, k, own, quantile_cont(x, 0.1) OVER (PARTITION BY series ORDER BY k RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS percentile FROM p) WHERE own""")
def trailing_percentile_rows(spark, sf_dir):
    return rounded(windows.trailing_percentile(binned(spark, sf_dir), 36, 0.1).select("series", "k", "percentile"))


@query(f"""WITH {E_SQL} SELECT series, id, round(CASE WHEN count(x) OVER w >= 5 THEN quantile_cont(x, 0.5) OVER w END, {DIGITS}) + 0.0 AS percentile FROM e
WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 21599 PRECEDING AND 600 PRECEDING)""")
def trailing_percentile_range(spark, sf_dir):
    return rounded(windows.trailing_range_percentile(samples(spark, sf_dir), 21600, 600, 0.5, 5).select("series", "id", "percentile"))


@query(f"""WITH {B}, z AS (SELECT series, min(k) AS a, max(k) AS z FROM b GROUP BY series), p AS (
  SELECT series, k, x, true AS own FROM b UNION ALL SELECT b.series, 2 * a - k, x, false FROM b JOIN z USING (series) WHERE k > a AND k <= a + 18
  UNION ALL SELECT b.series, 2 * z - k, x, false FROM b JOIN z USING (series) WHERE k < z AND k >= z - 18)
SELECT series, k, round(percentile, {DIGITS}) + 0.0 AS percentile FROM (
  SELECT series, k, own, quantile_cont(x, 0.1) OVER (PARTITION BY series ORDER BY k RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING) AS percentile FROM p) WHERE own""")
def centred_percentile(spark, sf_dir):
    return rounded(windows.centred_percentile(binned(spark, sf_dir), 36, 0.1).select("series", "k", "percentile"))


@query(f"WITH {B} {_bx(f'round(avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), {DIGITS}) + 0.0 AS mean')}")
def causal_mean(spark, sf_dir):
    return rounded(windows.causal_mean(binned(spark, sf_dir), 6).select("series", "k", "mean"))


@query(f"""WITH {B} SELECT series, k, round(CASE WHEN row_number() OVER w <= 3 THEN 0 ELSE coalesce(x, 0) - coalesce(lag(x, 3) OVER w, 0) END, {DIGITS}) + 0.0 AS diff,
  round(CASE WHEN row_number() OVER w <= 3 THEN 0 ELSE coalesce(x - lag(x, 3) OVER w, 0) END, {DIGITS}) + 0.0 AS diff_after FROM b WINDOW w AS (PARTITION BY series ORDER BY k)""")
def causal_diff(spark, sf_dir):
    b = binned(spark, sf_dir)
    return rounded(windows.causal_diff(windows.causal_diff(b, 3), 3, False, "diff_after").select("series", "k", "diff", "diff_after"))


@query(f"""WITH {B} SELECT series, k, round(CASE WHEN count(x) OVER w >= 0.5 * 6 THEN avg(x) OVER w END, {DIGITS}) + 0.0 AS mean FROM b
WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def centred_mean(spark, sf_dir):
    return rounded(windows.centred_mean(binned(spark, sf_dir), 6, least=0.5).select("series", "k", "mean"))


@query(f"""WITH {B}, s AS (SELECT series, k, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY k) AS i, count(*) OVER (PARTITION BY series) AS n, lag(s) OVER (PARTITION BY series ORDER BY k) AS p, lead(s) OVER (PARTITION BY series ORDER BY k) AS q FROM s)
SELECT series, k, round((CASE WHEN i = n THEN s ELSE q END - CASE WHEN i = 1 THEN s ELSE p END) / (CASE WHEN i = 1 OR i = n THEN 1 ELSE 2 END * 600.0), {DIGITS}) + 0.0 AS slope FROM r""")
def derivative(spark, sf_dir):
    return rounded(windows.derivative(binned(spark, sf_dir), 600.0, 5).select("series", "k", "slope"))


@query(f"""WITH {B}, d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY series ORDER BY k)) AS d, row_number() OVER (PARTITION BY series ORDER BY k) AS i FROM b)
SELECT series, k, round(CASE WHEN i > 2 AND count(x) OVER w >= 10 THEN quantile_cont(x, 0.5) OVER w END, {DIGITS}) + 0.0 AS background,
  round(CASE WHEN i > 2 AND count(d) OVER w >= 10 THEN quantile_cont(d, 0.5) OVER w * (1.4826 / sqrt(2.0)) END, {DIGITS}) + 0.0 AS noise FROM d
WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 59 PRECEDING AND 2 PRECEDING)""")
def trailing_background_noise(spark, sf_dir):
    return rounded(windows.background_noise(binned(spark, sf_dir), 600, 36000, 1200).select("series", "k", "background", "noise"))


@query(f"""WITH {E_SQL} SELECT series, id, min(x) OVER w AS low, round(CASE WHEN count(x) OVER w >= 0.3 * 7200 / 1200 THEN avg(x) OVER w END, {DIGITS}) + 0.0 AS mean FROM e
WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)""")
def rolling_hours(spark, sf_dir):
    out = windows.rolling(samples(spark, sf_dir), 7200, 1200, "min", "low", 0.0)
    return rounded(windows.rolling(out, 7200, 1200, "mean", "mean").select("series", "id", "low", "mean"), "low")


@query(f"WITH {B} {_bx('max(coalesce((x >= 100)::INT, 0)) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS occurs')}")
def lookahead_occurrence(spark, sf_dir):
    return windows.occurrence(binned(spark, sf_dir), 6, F.col("x") >= 100).select("series", "k", "occurs")


@query(f"WITH {B} SELECT series, k, round(lead(x, 1) OVER w, 9) + 0.0 AS lead_1, round(lead(x, 5) OVER w, 9) + 0.0 AS lead_5, round(lead(x, 30) OVER w, 9) + 0.0 AS lead_30 FROM b WINDOW w AS (PARTITION BY series ORDER BY k)")
def lead_targets(spark, sf_dir):
    return rounded(windows.leads(binned(spark, sf_dir), [1, 5, 30]).select("series", "k", "lead_1", "lead_5", "lead_30"))


@query(f"WITH {B} SELECT series, k, round(CASE WHEN count(x) OVER w >= 10 THEN max(x) OVER w END, 9) + 0.0 AS ahead FROM b WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)")
def lookahead_max30(spark, sf_dir):
    return rounded(windows.lookahead_max(binned(spark, sf_dir), 30, 10).select("series", "k", "ahead"))


@query(f"WITH {B} {_bx('min(CASE WHEN x >= 100 THEN k END) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_on')}")
def next_on(spark, sf_dir):
    return windows.next_on(binned(spark, sf_dir), F.col("x") >= 100, chunk=512).select("series", "k", "next_on")


@query(f"WITH {E_SQL} SELECT series, id, max(t + 60 * \"user\") OVER (PARTITION BY series ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS far FROM e")
def running_max_end(spark, sf_dir):
    e = samples(spark, sf_dir)
    return frames.running(e, [F.col("t"), F.col("id")], F.col("t") + 60 * F.col("user"), "far", F.floor(F.col("t") / 86400), how="max").select("series", "id", "far")


@query(f"""WITH {B}, o AS (SELECT *, max(CASE WHEN coalesce(x < 50, true) THEN k END) OVER (PARTITION BY series ORDER BY k) AS off, min(k) OVER (PARTITION BY series) - 1 AS a FROM b)
SELECT series, k, k - coalesce(off, a) AS streak FROM o""")
def run_lengths(spark, sf_dir):
    return windows.streak(binned(spark, sf_dir), F.col("x") >= 50, chunk=512).select("series", "k", "streak")


@query(f"""WITH {E_SQL}, r AS (SELECT series, id, floor(x) AS v FROM e)
SELECT series, id, rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 AS rank FROM r""")
def tied_ranks(spark, sf_dir):
    return windows.tied_ranks(samples(spark, sf_dir).withColumn("v", F.floor("x")), "v").select("series", "id", "rank")


@query(f"""WITH {b_sql(3600, 'h')} SELECT series, k, round(max(x) OVER (PARTITION BY series ORDER BY k ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS envelope FROM h""")
def monotone_envelope(spark, sf_dir):
    return rounded(windows.envelope(binned(spark, sf_dir, 3600), "x", "k").select("series", "k", "envelope"))


@query(f"""WITH {B}, o AS (SELECT *, k - lag(k) OVER (PARTITION BY series ORDER BY k) AS g FROM b WHERE x >= 60), r AS (SELECT *, sum((g IS NULL OR g > 6)::INT) OVER (PARTITION BY series ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT series, min(k) AS start, max(k) AS stop, count(*) AS n_on FROM r GROUP BY series, run""")
def episodes(spark, sf_dir):
    return detect.episodes(binned(spark, sf_dir), F.col("x") >= 60)


@query(f"""WITH {B}, g AS (SELECT series, k, x, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS bg FROM b),
h AS (SELECT *, k - row_number() OVER (PARTITION BY series ORDER BY k) AS run FROM g WHERE x >= 1.4 * bg AND x - bg >= 4 * sqrt(bg / 2.0))
SELECT series, min(k) AS first, max(k) AS last, arg_max(k, (x - bg, -k)) AS peak, round(max(x - bg), {DIGITS}) + 0.0 AS height FROM h GROUP BY series, run""")
def flare_threshold_runs(spark, sf_dir):
    g = windows.causal_mean(binned(spark, sf_dir), 36, "background")
    return rounded(detect.threshold_runs(g, 2.0))


@query(f"""WITH {B}, r AS (SELECT series, k, row_number() OVER (PARTITION BY series ORDER BY k) - 1 AS i, x FROM b), c AS (
  SELECT series, k, x, count(x) OVER w AS n, avg(x) OVER w AS mean_24, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS mean_2, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean_6,
    stddev_pop(x) OVER w AS sd, regr_slope(x, k) OVER w AS slope FROM b WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT series, k, {r_sql('mean_2', 'mean_6', 'mean_24', 'sd')}, round(n / 24.0, 9) + 0.0 AS available FROM c""")
def window_summary(spark, sf_dir):
    return rounded(labels.window_summary(binned(spark, sf_dir), 24).select("series", "k", "mean_2", "mean_6", "mean_24", "sd", "available"))


@query(f"""WITH {E_SQL}, w AS (SELECT series, t, x, min(x) OVER a AS min_6h, max(x) OVER a AS max_6h, avg(x) OVER a AS mean_6h FROM e WINDOW a AS (PARTITION BY series ORDER BY t RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, row_number() OVER (PARTITION BY series, t // 3600 ORDER BY t DESC, x DESC) AS r FROM w)
SELECT series, t // 3600 AS hour, min_6h, max_6h, round(mean_6h, 9) + 0.0 AS mean_6h FROM l WHERE r = 1""")
def hourly_activity(spark, sf_dir):
    return rounded(activity.hourly(samples(spark, sf_dir), 1200, (6,)).select("series", "hour", "min_6h", "max_6h", "mean_6h"), "min_6h", "max_6h")


@query(f"""WITH {B} SELECT series, k, round(x + 15.0 / 5 * greatest(x - lag(x, 5) OVER w, 0.0), 9) + 0.0 AS trend FROM b WHERE true WINDOW w AS (PARTITION BY series ORDER BY k)""".replace("greatest(x - lag(x, 5) OVER w, 0.0)", "greatest(coalesce(x - lag(x, 5) OVER w, 0.0), 0.0)"))
def trend_signal(spark, sf_dir):
    return rounded(alerts.trend(binned(spark, sf_dir)).select("series", "k", "trend"))


@query(f"""WITH {E_SQL}, u AS (SELECT DISTINCT series, t FROM e), o AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS g FROM u), r AS (SELECT *, sum((g IS NULL OR g > 1800)::INT) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM o),
b AS (SELECT series, run, max(t) - min(t) AS len, count(*) AS n FROM r GROUP BY ALL) SELECT series, count(*) AS batches, quantile_cont(len, 0.5)::DOUBLE AS length, quantile_cont(n, 0.5)::DOUBLE AS size FROM b GROUP BY series""")
def sample_batches(spark, sf_dir):
    return detect.batches(samples(spark, sf_dir), 1800)
