"""Temporal joins, labels, alerts and per-event numbers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.operators import activity, alerts, detect, labels, physics, temporal

from .base import DIGITS, E_SQL, a_sql, active, b_sql, binned, r_sql, rounded, samples
from .registry import query

DAY = 1 << 17


def _pair(spark, sf_dir):
    """Clicks and errors as one pair of series."""
    e = samples(spark, sf_dir)
    one = lambda s: e.where(F.col("series") == s).select(F.lit(0).alias("series"), "t", "us", "x", "id")
    return one("click"), one("error")


_P = f"{E_SQL}, l AS (SELECT t, us, x, id FROM e WHERE series = 'click'), r AS (SELECT t, us, x, id FROM e WHERE series = 'error')"


@query(f"""WITH {_P}, j AS (SELECT l.id, l.us, r.us AS rus, r.x AS rx, r.id AS rid FROM l ASOF LEFT JOIN (SELECT us, max(id) AS id, arg_max(x, id) AS x FROM r GROUP BY us) r ON l.us >= r.us)
SELECT id, CASE WHEN us - rus < 1800000000 THEN rx END AS asof_x, CASE WHEN us - rus < 1800000000 THEN rid END AS asof_id FROM j""")
def asof_backward_tol(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    out = temporal.asof(a, b, ["id", "x"], 86_400_000_000, 1_800_000_000, True, t="us")
    return out.select("id", "asof_x", "asof_id")


@query(f"""WITH {_P} SELECT l.id, CASE WHEN l.us - 7200000000 - r.us <= 21600000000 THEN r.x END AS late_x FROM l ASOF LEFT JOIN (SELECT us, arg_max(x, id) AS x FROM r GROUP BY us) r ON l.us - 7200000000 >= r.us""")
def asof_latency(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    seen = b.withColumn("us", F.col("us") + 7_200_000_000)  # known two hours later
    return temporal.asof(a, seen, ["id", "x"], 86_400_000_000, 21_600_000_000, t="us", names="late_").select("id", "late_x")


@query(f"""WITH {_P}, j AS (SELECT l.id, l.us, b.us AS bus, b.x AS bx, f.us AS fus, f.x AS fx FROM (SELECT l.*, r.us AS _u FROM l ASOF LEFT JOIN (SELECT DISTINCT us FROM r) r ON l.us >= r.us) l
  LEFT JOIN (SELECT us, max(x) AS x FROM r GROUP BY us) b ON b.us = _u LEFT JOIN (SELECT l2.id AS i, f.us, f.x FROM l l2 ASOF LEFT JOIN (SELECT us, min(x) AS x FROM r GROUP BY us) f ON l2.us <= f.us) f ON f.i = l.id)
SELECT id, CASE WHEN fus IS NULL OR us - bus <= fus - us THEN bx ELSE fx END AS nearest_x, CASE WHEN fus IS NULL OR us - bus <= fus - us THEN us - bus ELSE fus - us END AS distance FROM j""")
def asof_nearest(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return temporal.nearest(a, b, ["x"], 86_400_000_000, t="us").select("id", "nearest_x", "distance")


# Roles are whole event types, and a user's events are a series of their own.
_I = f"""{E_SQL}, i AS (SELECT "user" AS series, id, t AS start, t + 40000 + 100 * round_even(x, 0)::BIGINT AS stop FROM e WHERE series = 'click'),
v AS (SELECT "user" AS series, t AS start, t + 30000 AS stop FROM e WHERE series = 'view'), bp AS (SELECT "user" AS series, id, t, x FROM e WHERE series = 'error')"""


def _roles(spark, sf_dir):
    """Clicks as intervals, views as intervals, errors as points, of each user."""
    e = samples(spark, sf_dir)
    role = lambda kind: e.where(F.col("series") == kind).withColumn("series", F.col("user"))
    i = role("click").select("series", "id", F.col("t").alias("start"), (F.col("t") + 40000 + 100 * F.rint("x").cast("long")).alias("stop"))
    return i, role("view").select("series", F.col("t").alias("start"), (F.col("t") + 30000).alias("stop")), role("error").select("series", "id", "t", "x")


def _purchases(spark, sf_dir):
    """Every purchase as an event, and all events as the one series it stands in."""
    e = samples(spark, sf_dir).withColumn("series", F.when(F.col("series") == "purchase", 1).otherwise(0).alias("series"))
    one = e.select(F.lit(0).alias("series"), "t", "x", "id", F.col("series").alias("role"))
    return one.where("role = 1").select("series", F.col("id").alias("event"), F.col("t").alias("start"), F.col("t").alias("stop")), one.drop("role")


@query(f"WITH {_I} SELECT series, id, start, stop FROM i WHERE EXISTS (SELECT 1 FROM v WHERE v.series = i.series AND v.start <= i.stop AND v.stop >= i.start)")
def interval_overlap_semi(spark, sf_dir):
    i, v, _ = _roles(spark, sf_dir)
    return temporal.overlapping(i, v, DAY).where("overlaps").drop("overlaps")


@query(f"WITH {_I} SELECT series, id, start, stop FROM i WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.series = i.series AND v.start <= i.stop AND v.stop >= i.start)")
def interval_overlap_anti(spark, sf_dir):
    i, v, _ = _roles(spark, sf_dir)
    return temporal.overlapping(i, v, DAY).where("NOT overlaps").drop("overlaps")


@query(f"""WITH {_I}, m AS (SELECT DISTINCT "user" AS series, t // 3600 AS k FROM e)
SELECT i.series, i.id, round((SELECT count(*) FROM m WHERE m.series = i.series AND m.k BETWEEN i.start // 3600 AND i.stop // 3600) / (i.stop // 3600 - i.start // 3600 + 1), {DIGITS}) + 0.0 AS fraction FROM i""")
def coverage_fraction(spark, sf_dir):
    i, _, _ = _roles(spark, sf_dir)
    steps = samples(spark, sf_dir).select(F.col("user").alias("series"), F.floor(F.col("t") / 3600).alias("k"))
    return rounded(temporal.coverage(i, steps, 3600).select("series", "id", "fraction"))


@query(f"""WITH {_I}, p AS (SELECT series, id AS burst, t FROM bp), j AS (
  SELECT p.series, p.burst, i.id AS event, row_number() OVER (PARTITION BY p.series, p.burst ORDER BY i.start DESC, i.id DESC) AS r FROM p JOIN i ON p.series = i.series AND p.t BETWEEN i.start - 300 AND i.stop)
SELECT p.series, p.burst, j.event FROM p LEFT JOIN j ON p.series = j.series AND p.burst = j.burst AND r = 1""")
def attach_latest_start(spark, sf_dir):
    i, _, points = _roles(spark, sf_dir)
    p = points.select("series", F.col("id").alias("burst"), "t")
    return temporal.attach_latest(p, i.withColumnRenamed("id", "event"), 1 << 14).select("series", "burst", "event")


@query(f"""WITH {_I}, s AS (SELECT series, id AS soft, start, start + 300 AS peak, stop FROM i), h AS (SELECT series, id AS hard, t AS start, t + 60 AS peak, x AS sigma FROM bp),
j AS (SELECT h.*, s.soft, row_number() OVER (PARTITION BY hard ORDER BY s.start, s.soft) AS r FROM h JOIN s ON h.series = s.series AND h.peak BETWEEN s.start - 300 AND s.stop),
u AS (SELECT soft, hard, row_number() OVER (PARTITION BY soft ORDER BY sigma DESC, peak, hard) AS r, count(*) OVER (PARTITION BY soft) AS n FROM j WHERE r = 1)
SELECT s.series, CASE WHEN u.hard IS NULL THEN 'soft' ELSE 'soft+hard' END AS origin, s.soft, u.hard, coalesce(n, 0) AS n_hard, start, peak FROM s LEFT JOIN u ON s.soft = u.soft AND u.r = 1
UNION ALL SELECT series, 'hard', NULL, hard, 1, start, peak FROM h WHERE hard NOT IN (SELECT hard FROM j)""")
def merge_catalogue(spark, sf_dir):
    i, _, points = _roles(spark, sf_dir)
    soft = i.select("series", F.col("id").alias("soft"), "start", (F.col("start") + 300).alias("peak"), "stop")
    hard = points.select("series", F.col("id").alias("hard"), F.col("t").alias("start"), (F.col("t") + 60).alias("peak"), (F.col("t") + 120).alias("stop"), F.col("x").alias("sigma"))
    return temporal.merge_catalogues(soft, hard, 1 << 14)


@query(f"""WITH {_I} SELECT i.id AS event, e.id, e.t - i.start AS since FROM i JOIN e ON e."user" = i.series AND e.t BETWEEN i.start - 1500 AND i.stop + 900""")
def event_slices(spark, sf_dir):
    i, _, _ = _roles(spark, sf_dir)
    e = samples(spark, sf_dir).withColumn("series", F.col("user"))
    return temporal.slices(i.withColumnRenamed("id", "event"), e, 1500, 900, 1 << 14).select("event", "id", "since")


@query(f"""WITH {E_SQL}, s AS (SELECT i.id AS event, e.x, e.t - i.t AS since FROM e i JOIN e ON i.series = 'purchase' AND e.t BETWEEN i.t - 14400 AND i.t + 7200),
f AS (SELECT event, count(x) AS n, quantile_cont(x, 0.5) FILTER (since < 0) AS background, max(x) AS top, max(x) FILTER (since <= 1800) AS top_known, arg_max(since, (x, -since)) AS top_at FROM s GROUP BY event)
SELECT event, n, {r_sql('background')}, top, top_known, top_at, round(CASE WHEN background > 0 THEN top / background END, 9) + 0.0 AS rise FROM f""")
def flare_records(spark, sf_dir):
    i, e = _purchases(spark, sf_dir)
    return rounded(physics.flare_record(i, e, 14400, 7200, 1800).select("event", "n", "background", "top", "top_known", "top_at", "rise"), "top", "top_known")


@query(f"""WITH {E_SQL}, s AS (SELECT i.id AS event, e.x, e.t - i.t AS since FROM e i JOIN e ON i.series = 'purchase' AND e.t BETWEEN i.t - 28800 AND i.t + 7200),
p AS (SELECT event, count(*) AS n, coalesce(regr_slope(x, since), 0) AS s FROM s WHERE since < 0 GROUP BY 1), q AS (SELECT event, n, CASE WHEN n >= 16 THEN least(s, 0) ELSE 0 END AS slope FROM p),
r AS (SELECT s.event, q.n, q.slope, x - slope * since AS r FROM s JOIN q USING (event) WHERE since < 0), l AS (SELECT event, n, slope, quantile_cont(r, 0.5) AS level FROM r GROUP BY ALL)
SELECT event, l.n, round(CASE WHEN l.n >= 8 THEN l.slope END, 6) + 0.0 AS slope, round(CASE WHEN l.n >= 8 THEN level END, 7) + 0.0 AS level, round(CASE WHEN l.n >= 8 THEN (SELECT quantile_cont(abs(r.r - level), 0.5) FROM r WHERE r.event = l.event) * 1.4826 END, 7) + 0.0 AS scatter FROM l""")
def linear_background(spark, sf_dir):
    i, e = _purchases(spark, sf_dir)
    out = detect.backgrounds(i, e, 28800)
    return out.select("event", "n", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("level", 7) + 0.0).alias("level"), (F.round("scatter", 7) + 0.0).alias("scatter"))


@query(f"""WITH {E_SQL}, g AS (SELECT i.id AS event, ((e.t - i.t) // 600)::BIGINT AS k, round(avg(e.x), 9) AS x FROM e i JOIN e ON i.series = 'purchase' AND e.t BETWEEN i.t AND i.t + 21600 GROUP BY ALL),
h AS (SELECT event, k, k - row_number() OVER (PARTITION BY event ORDER BY k) AS run FROM g WHERE x / 20 > 1), r AS (SELECT event, min(k) AS onset FROM h GROUP BY event, run HAVING count(*) >= 3)
SELECT event, min(onset) AS onset, min(onset) + 2 AS known FROM r GROUP BY event""")
def causal_onset(spark, sf_dir):
    i, e = _purchases(spark, sf_dir)
    return detect.causal_onsets(i, e, 600, 21600, lambda x: x / 20, least=1.0).select("event", "onset", "known")


@query(f"""WITH {E_SQL}, s AS (SELECT i.id AS event, e.x, e.t - i.t AS since FROM e i JOIN e ON i.series = 'purchase' AND e.t BETWEEN i.t - 28800 AND i.t + 7200),
m AS (SELECT event, count(x) FILTER (since BETWEEN -1800 AND -600) AS n, count(x) FILTER (abs(since) <= 120) AS m, quantile_cont(x, 0.5) FILTER (since BETWEEN -1800 AND -600) AS med, max(x) FILTER (abs(since) <= 120) AS top FROM s GROUP BY event),
d AS (SELECT event, quantile_cont(abs(x - med), 0.5) AS mad FROM s JOIN m USING (event) WHERE since BETWEEN -1800 AND -600 GROUP BY event)
SELECT event, round(CASE WHEN n >= 10 AND m >= 3 THEN (top - med) / greatest(1.4826 * mad, sqrt(greatest(med, 1))) END, 9) + 0.0 AS significance FROM m LEFT JOIN d USING (event)""")
def hot_excess(spark, sf_dir):
    i, e = _purchases(spark, sf_dir)
    return rounded(detect.hot_excesses(i, e).select("event", "significance"))


@query(f"""WITH {E_SQL}, p AS (SELECT series, floor(x / 5)::BIGINT AS channel, count(*) AS c FROM e GROUP BY ALL), s AS (SELECT g.series, g.channel, coalesce(p.c, 0)::DOUBLE AS counts FROM (SELECT series, unnest(range(min(channel), max(channel) + 1)) AS channel FROM p GROUP BY series) g LEFT JOIN p ON p.series = g.series AND p.channel = g.channel),
w AS (SELECT *, quantile_cont(counts, 0.5) OVER (PARTITION BY series ORDER BY channel ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS c, lag(counts, 1, '-inf'::DOUBLE) OVER (PARTITION BY series ORDER BY channel) AS p, lead(counts, 1, '-inf'::DOUBLE) OVER (PARTITION BY series ORDER BY channel) AS n FROM s)
SELECT series, channel, round(counts - c, 9) + 0.0 AS excess FROM w WHERE counts > p AND counts >= n AND counts - c >= 3""")
def line_peaks(spark, sf_dir):
    from gapline.operators.grid import spine

    s = samples(spark, sf_dir).groupBy("series", F.floor(F.col("x") / 5).alias("channel")).agg(F.count(F.lit(1)).cast("double").alias("counts"))
    return rounded(detect.line_peaks(spine(s, "channel").fillna(0.0, ["counts"]), 4, 3.0))


A = a_sql()


@query(f"""WITH {A}, p AS (SELECT series, event, unnest([{{'l': 3, 'q': 0, 'a': peak, 'z': stop}}, {{'l': 1, 'q': 1, 'a': start, 'z': peak - 1}}, {{'l': 2, 'q': 2, 'a': peak - 1, 'z': peak + 1}}]) AS p FROM a),
j AS (SELECT h.series, h.k, arg_max(p.l, (p.event, p.p.q)) AS phase FROM h JOIN (SELECT series, event, p, p.l AS l FROM p) p ON p.series = h.series AND h.k BETWEEN p.p.a AND p.p.z GROUP BY ALL)
SELECT h.series, h.k, coalesce(phase, 0)::INT AS phase FROM h LEFT JOIN j ON j.series = h.series AND j.k = h.k""")
def phase_labels(spark, sf_dir):
    return labels.phases(binned(spark, sf_dir, 3600), active(spark, sf_dir), 1, 64).select("series", "k", "phase")


@query(f"""WITH {A}, j AS (SELECT h.series, h.k, arg_max((a.magnitude >= 1.0)::INT + (a.magnitude >= 2.0)::INT + (a.magnitude >= 3.0)::INT, a.event) AS m FROM h JOIN a ON a.series = h.series AND h.k BETWEEN a.start AND a.stop GROUP BY ALL)
SELECT h.series, h.k, coalesce(m, 0)::INT AS magnitude FROM h LEFT JOIN j ON j.series = h.series AND j.k = h.k""")
def magnitude_class(spark, sf_dir):
    return labels.magnitude_class(binned(spark, sf_dir, 3600), active(spark, sf_dir), (1.0, 2.0, 3.0), 64).select("series", "k", "magnitude")


@query(f"""WITH {A}, j AS (SELECT h.series, h.k, arg_max({{'e': a.event, 'p': a.peak, 'v': a.peak_value}}, a.event) AS e FROM h JOIN a ON a.series = h.series AND h.k BETWEEN a.start AND a.peak GROUP BY ALL)
SELECT series, k, e.e AS event, round((e.p - k) * 3600.0 / 3600, 9) + 0.0 AS hours, round(log10(e.v), 9) + 0.0 AS log_peak FROM j""")
def peak_targets(spark, sf_dir):
    return rounded(labels.peak_targets(binned(spark, sf_dir, 3600), active(spark, sf_dir), 3600.0, 64))


@query(f"""WITH {A}, w AS (SELECT series, event, start - 6 AS start, peak, peak_value FROM a), q AS (SELECT quantile_cont(peak_value, 0.75) AS bar FROM w),
s AS (SELECT series, event, peak, peak_value, unnest(range(start + 1, floor(start + (peak - start) * 0.8)::BIGINT + 1, 2)) AS "at" FROM w WHERE start + 1 <= floor(start + (peak - start) * 0.8))
SELECT series, event, "at", peak - "at" AS to_peak, (peak_value >= bar)::INT AS exceeds FROM s, q""")
def rise_samples(spark, sf_dir):
    return labels.rise_samples(active(spark, sf_dir).withColumn("start", F.col("start") - 6), 1, 2, 0.8)


@query(f"""WITH {b_sql()}, r AS (SELECT series, k, x, row_number() OVER (PARTITION BY series ORDER BY k) AS i, count(*) OVER (PARTITION BY series) AS n, count(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS seen FROM b)
SELECT series, k + 1 AS stop, round(seen / 36, 9) + 0.0 AS observed FROM r WHERE i >= 36 AND (i - 36) % 4 = 0 AND i + 18 <= n AND seen >= 0.3 * 36 AND x IS NOT NULL""")
def enumerate_windows(spark, sf_dir):
    return rounded(labels.enumerate_windows(binned(spark, sf_dir), 36, 4, 18, 0.3))


_WIN = f"""{b_sql()}, r AS (SELECT series, k, x, row_number() OVER (PARTITION BY series ORDER BY k) AS i, count(*) OVER (PARTITION BY series) AS n, count(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS seen FROM b),
win AS (SELECT series, k + 1 AS stop FROM r WHERE i >= 36 AND (i - 36) % 4 = 0 AND i + 18 <= n AND seen >= 0.3 * 36 AND x IS NOT NULL)"""


@query(f"""WITH {_WIN}, c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY stop) AS u, count(*) OVER (PARTITION BY series) AS al FROM win),
t AS (SELECT series, max(stop) FILTER (u <= floor(al * 0.6)) AS ta, max(stop) FILTER (u <= floor(al * 0.6) + floor(al * 0.2)) AS tb FROM c GROUP BY series)
SELECT c.series, stop, CASE WHEN stop <= ta THEN 'train' WHEN stop <= tb THEN 'valid' ELSE 'test' END AS part FROM c JOIN t USING (series) WHERE stop <= ta OR (stop > ta + 6 AND stop <= tb) OR stop > tb + 6""")
def chrono_split_embargo(spark, sf_dir):
    w = labels.enumerate_windows(binned(spark, sf_dir), 36, 4, 18, 0.3).select("series", "stop")
    return labels.chronological_split(w, 6).select("series", "stop", "part")


@query(f"""WITH {A}, c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY peak, event) AS r, count(*) OVER (PARTITION BY series) AS n FROM a)
SELECT series, event, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train' WHEN r <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'valid' ELSE 'test' END AS part FROM c""")
def event_level_split(spark, sf_dir):
    return labels.event_split(active(spark, sf_dir)).select("series", "event", "part")


@query(f"""WITH {A}, w AS (SELECT DISTINCT series, k + 1 AS stop FROM h WHERE x IS NOT NULL)
SELECT series, stop FROM w WHERE EXISTS (SELECT 1 FROM a WHERE a.series = w.series AND a.start <= w.stop + 2 AND a.stop >= w.stop - 3) OR stop // 2 % 4 = 0""")
def thin_quiet(spark, sf_dir):
    w = binned(spark, sf_dir, 3600).where("x IS NOT NULL").select("series", (F.col("k") + 1).alias("stop"))
    return labels.thin_quiet(w, active(spark, sf_dir), 3, 3, 2, 4, 64)


@query(f"""WITH {E_SQL}, v AS (SELECT 'x' AS col, x FROM e UNION ALL SELECT 'user', "user"::DOUBLE FROM e), q AS (SELECT col, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM v GROUP BY col)
SELECT col AS "column", round(q[2], 9) + 0.0 AS centre, round((q[3] - q[1]) / 1.349, 9) + 0.0 AS scale FROM q""")
def robust_normalizer(spark, sf_dir):
    return rounded(labels.normalizer(samples(spark, sf_dir), ["x", "user"]))


@query(f"""WITH {A}, c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY peak, event) AS r, greatest(1, count(*) OVER (PARTITION BY series) // 6) AS s FROM a)
SELECT series, event, least(5, (r - 1) // s) AS block FROM c""")
def rolling_folds(spark, sf_dir):
    return labels.folds(active(spark, sf_dir), 5).select("series", "event", F.col("block").cast("long").alias("block"))


@query(f"""WITH {A}, w AS (SELECT series, event, start, peak, max(peak) OVER (PARTITION BY series ORDER BY peak, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
s AS (SELECT series, event, greatest(start - 3, coalesce(p + 1, start - 3)) AS start, peak AS stop FROM w), m AS (SELECT series, k FROM h WHERE n > 0)
SELECT series, event, start, stop, fraction FROM (SELECT *, round((SELECT count(*) FROM m WHERE m.series = s.series AND m.k BETWEEN s.start AND s.stop) / (stop - start + 1), 9) + 0.0 AS fraction FROM s WHERE start <= stop) WHERE fraction >= 0.8""")
def alert_windows(spark, sf_dir):
    steps = binned(spark, sf_dir, 3600).where("n > 0").select("series", "k")
    return rounded(alerts.windows_before(active(spark, sf_dir), steps, 3))


_SP = f"""{A}, w AS (SELECT series, event, start, peak, max(peak) OVER (PARTITION BY series ORDER BY peak, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
sp AS (SELECT series, event, greatest(start - 3, coalesce(p + 1, start - 3)) AS start, peak AS stop FROM w WHERE greatest(start - 3, coalesce(p + 1, start - 3)) <= peak)"""


def _spans(spark, sf_dir):
    return alerts.windows_before(active(spark, sf_dir), binned(spark, sf_dir, 3600).select("series", "k"), 3, 0.0).select("series", "event", "start", "stop")


@query(f"""WITH {_SP}, m AS (SELECT series, event, s AS shift, start + s AS start, stop + s AS stop FROM sp, (SELECT unnest([-24, 24]) AS s))
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.series = m.series AND a.start <= m.stop AND a.stop >= m.start)""")
def chance_windows(spark, sf_dir):
    return alerts.shifted(_spans(spark, sf_dir), active(spark, sf_dir), [-24, 24], 64)


@query(f"""WITH {A}, o AS (SELECT *, k - lag(k) OVER (PARTITION BY series ORDER BY k) AS g FROM h WHERE x >= 60), r AS (SELECT *, sum((g IS NULL OR g > 6)::INT) OVER (PARTITION BY series ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT series, min(k) AS start, max(k) AS stop FROM r GROUP BY series, run), f AS (SELECT p.*, EXISTS (SELECT 1 FROM a WHERE a.series = p.series AND a.start - 30 <= p.stop AND a.stop + 15 >= p.start) AS o FROM p),
d AS (SELECT series, count(*) / 1440 AS days, avg(coalesce((x >= 60)::INT, 0)) AS duty FROM h GROUP BY 1), c AS (SELECT series, count(*) AS episodes, count(*) FILTER (NOT o) AS false FROM f GROUP BY 1)
SELECT series, {r_sql('days', 'duty')}, coalesce(episodes, 0) AS episodes, coalesce("false", 0) AS "false", round(coalesce("false", 0) / days, 9) + 0.0 AS false_per_day FROM d LEFT JOIN c USING (series)""")
def false_alarms_per_day(spark, sf_dir):
    return rounded(alerts.false_alarms(binned(spark, sf_dir, 3600), F.col("x") >= 60, active(spark, sf_dir), width=64))


@query(f"""WITH {_SP}, f AS (SELECT sp.*, (SELECT min(k) FROM h WHERE h.series = sp.series AND h.x >= 60 AND h.k BETWEEN sp.start AND sp.stop) AS f FROM sp)
SELECT series, event, start, stop, f IS NOT NULL AS warned, stop - f AS lead FROM f""")
def lead_times(spark, sf_dir):
    return alerts.lead_times(binned(spark, sf_dir, 3600), F.col("x") >= 60, _spans(spark, sf_dir), chunk=64)


@query(f"""WITH {_SP}, f AS (SELECT sp.*, (SELECT min(k) FROM h WHERE h.series = sp.series AND h.x >= 60 AND h.k BETWEEN sp.start AND sp.stop) AS f FROM sp)
SELECT series, count(*) AS n, round(avg((f IS NOT NULL)::INT), 9) + 0.0 AS tpr, round(quantile_cont(stop - f, 0.25), 9) + 0.0 AS lead_q25, round(quantile_cont(stop - f, 0.5), 9) + 0.0 AS lead_q50, round(quantile_cont(stop - f, 0.75), 9) + 0.0 AS lead_q75,
  round(avg(coalesce((stop - f >= 5)::INT, 0)), 9) + 0.0 AS lead_5, round(avg(coalesce((stop - f >= 10)::INT, 0)), 9) + 0.0 AS lead_10 FROM f GROUP BY series""")
def lead_summary(spark, sf_dir):
    return rounded(alerts.lead_summary(alerts.lead_times(binned(spark, sf_dir, 3600), F.col("x") >= 60, _spans(spark, sf_dir), chunk=64)))


@query(f"""WITH {_SP}, th AS (SELECT unnest([40.0, 60.0, 80.0, 100.0]::DOUBLE[]) AS threshold), o AS (SELECT th.threshold, h.series, k, k - lag(k) OVER (PARTITION BY th.threshold, h.series ORDER BY k) AS g FROM h, th WHERE x >= th.threshold),
r AS (SELECT *, sum((g IS NULL OR g > 6)::INT) OVER (PARTITION BY threshold, series ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o), p AS (SELECT threshold, series, min(k) AS start, max(k) AS stop FROM r GROUP BY threshold, series, run),
f AS (SELECT threshold, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.series = p.series AND a.start - 30 <= p.stop AND a.stop + 15 >= p.start)) AS f FROM p GROUP BY 1),
l AS (SELECT threshold, avg((EXISTS (SELECT 1 FROM h WHERE h.series = sp.series AND h.x >= threshold AND h.k BETWEEN sp.start AND sp.stop))::INT) AS tpr FROM sp, th GROUP BY 1),
z AS (SELECT threshold, coalesce(f, 0) AS "false", tpr, coalesce(f, 0) / (SELECT count(*) / 1440 FROM h) AS fpd FROM th LEFT JOIN f USING (threshold) LEFT JOIN l USING (threshold))
SELECT threshold, "false", round(tpr, 9) + 0.0 AS tpr, round(fpd, 9) + 0.0 AS false_per_day, coalesce(threshold = (SELECT min(threshold) FROM z WHERE fpd <= 10), false) AS chosen FROM z""")
def operating_points(spark, sf_dir):
    return rounded(alerts.operating_points(binned(spark, sf_dir, 3600), "x", [40.0, 60.0, 80.0, 100.0], active(spark, sf_dir), _spans(spark, sf_dir), 10.0))


def _big(spark, sf_dir):
    e = samples(spark, sf_dir)
    origins = e.groupBy("series", F.floor(F.col("t") / 3600).alias("hour")).count().select("series", (F.col("hour") * 3600 + 3600).alias("t"))
    return origins, e.where("x >= 120").select("series", "t")


_O = f"{E_SQL}, o AS (SELECT DISTINCT series, t // 3600 * 3600 + 3600 AS t FROM e), v AS (SELECT series, t FROM e WHERE x >= 120)"


@query(f"""WITH {_O} SELECT series, t, (SELECT count(*) FROM v WHERE v.series = o.series AND v.t > o.t - 21600 AND v.t <= o.t) AS n_21600, (SELECT count(*) FROM v WHERE v.series = o.series AND v.t > o.t - 86400 AND v.t <= o.t) AS n_86400 FROM o""")
def event_counts_trailing(spark, sf_dir):
    return activity.event_counts(*_big(spark, sf_dir), (6, 24), 86400)


@query(f"WITH {_O} SELECT series, t, round(least(168.0, coalesce((t - (SELECT max(t) FROM v WHERE v.series = o.series AND v.t <= o.t)) / 3600.0, 168.0)), 9) + 0.0 AS hours_since FROM o")
def hours_since_last(spark, sf_dir):
    return rounded(activity.hours_since(*_big(spark, sf_dir), chunk=86400))


@query(f"""WITH {_O}, m AS (SELECT DISTINCT series, t // 3600 AS k FROM e), z AS (SELECT *, (SELECT count(*) FROM m WHERE m.series = o.series AND m.k BETWEEN o.t // 3600 + 1 AND o.t // 3600 + 24) / 24 AS f, EXISTS (SELECT 1 FROM v WHERE v.series = o.series AND v.t > o.t AND v.t <= o.t + 86400) AS h FROM o)
SELECT series, t, round(f, 9) + 0.0 AS fraction, CASE WHEN f >= 0.8 THEN h::INT END AS target FROM z""")
def dayahead_targets(spark, sf_dir):
    o, v = _big(spark, sf_dir)
    steps = samples(spark, sf_dir).select("series", F.floor(F.col("t") / 3600).alias("k"))
    return rounded(activity.day_ahead(o, v, steps, 86400, 3600, chunk=86400))


@query(f"""WITH {E_SQL}, g AS (SELECT t // 3600 AS k, avg(x) FILTER (series = 'click') AS x, avg(x) FILTER (series = 'error') AS y, (t // 3600) // 240 AS series FROM e GROUP BY ALL),
c AS (SELECT a.series, l.lag, corr(a.x, b.y) AS r, count(*) AS n FROM g a, (SELECT unnest(range(-5, 6)) AS lag) l, g b WHERE b.series = a.series AND b.k = a.k + l.lag AND a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(r, 12) DESC, lag) AS q FROM c WHERE r IS NOT NULL AND NOT isnan(r))
SELECT series, lag::INT AS lag, round(r, 9) + 0.0 AS r, n FROM o WHERE q = 1""")
def lagged_correlation(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy(F.floor(F.col("t") / 3600).alias("k")).agg(F.avg(F.when(F.col("series") == "click", F.col("x"))).alias("x"), F.avg(F.when(F.col("series") == "error", F.col("x"))).alias("y"))
    return rounded(physics.lagged_correlation(g.withColumn("series", F.floor(F.col("k") / 240)), "x", "y", 5))


@query(f"""WITH {b_sql()}, s AS (SELECT series, k, sum(n) OVER w AS s, count(*) OVER w AS c FROM b WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT series, arg_max(k, (s, -k)) AS start, max(s)::BIGINT AS total FROM s WHERE c = 16 GROUP BY series""")
def peak_interval(spark, sf_dir):
    return physics.peak_interval(binned(spark, sf_dir), 16)


_RISE_SQL = f"""WITH RECURSIVE {b_sql(7200)}, g AS (
  SELECT series, k, round(x, 9) AS x, row_number() OVER w AS i, coalesce(lead(k) OVER w = k + 1 AND lead(round(x, 9)) OVER w > round(x, 9), false) AS rising FROM b WHERE x > 0 WINDOW w AS (PARTITION BY series ORDER BY k)
), walk AS (
  SELECT series, i, k, CASE WHEN rising THEN k END AS s, CASE WHEN rising THEN x END AS low, CASE WHEN rising THEN k END AS p, CASE WHEN rising THEN x END AS top,
    NULL::BIGINT AS start, NULL::BIGINT AS peak, NULL::BIGINT AS stop, NULL::DOUBLE AS start_value, NULL::DOUBLE AS peak_value, NULL::VARCHAR AS reason FROM g WHERE i = 1
  UNION ALL
  SELECT series, gi, gk, CASE WHEN s IS NOT NULL AND why IS NULL THEN s WHEN rising THEN gk END, CASE WHEN s IS NOT NULL AND why IS NULL THEN low WHEN rising THEN gx END,
    CASE WHEN s IS NOT NULL AND why IS NULL THEN CASE WHEN gx > top THEN gk ELSE p END WHEN rising THEN gk END, CASE WHEN s IS NOT NULL AND why IS NULL THEN greatest(top, gx) WHEN rising THEN gx END,
    CASE WHEN why IS NOT NULL THEN s END, CASE WHEN why IS NOT NULL THEN p END, CASE why WHEN 'gap' THEN k ELSE gk END, low, top, why
  FROM (SELECT w.series, w.k, w.s, w.low, w.p, w.top, g.i AS gi, g.k AS gk, g.x AS gx, g.rising,
      CASE WHEN w.s IS NULL THEN NULL WHEN g.k - w.k - 1 > 3 THEN 'gap' WHEN g.x > w.top THEN NULL WHEN g.rising THEN 'next_flare' WHEN w.top - g.x >= 0.5 * (w.top - w.low) THEN 'decay' END AS why
    FROM walk w JOIN g ON g.series = w.series AND g.i = w.i + 1)
), z AS (SELECT series, max(k) AS z FROM b GROUP BY series),
c AS (
  SELECT series, start, peak, stop, start_value, peak_value, reason FROM walk WHERE reason IS NOT NULL
  UNION ALL SELECT series, s, p, k, low, top, CASE WHEN z - k > 3 THEN 'gap' ELSE 'data_end' END FROM walk JOIN z USING (series) WHERE s IS NOT NULL AND (series, i) IN (SELECT series, max(i) FROM g GROUP BY series)
), h AS (SELECT c.*, (SELECT min(g.k) + 1 FROM g WHERE g.series = c.series AND g.k BETWEEN c.start + 1 AND c.stop AND g.x >= 1.2 * c.start_value) AS alert FROM c),
r AS (SELECT *, sum((alert IS NOT NULL OR coalesce(start - before > 1, true))::INT) OVER (PARTITION BY series ORDER BY start) AS run FROM (SELECT *, lag(stop) OVER (PARTITION BY series ORDER BY start) AS before FROM h))
SELECT series, min(start) AS start, arg_max(peak, (peak_value, -start)) AS peak, arg_max(stop, start) AS stop, min(alert) AS alert, arg_min(start_value, start) AS start_value, max(peak_value) AS peak_value, arg_max(reason, start) AS reason
FROM r GROUP BY series, run HAVING min(alert) IS NOT NULL"""


@query(_RISE_SQL)
def rise_rule_events(spark, sf_dir):
    m = binned(spark, sf_dir, 7200).withColumn("x", F.round("x", 9))
    return detect.rise_events(m, 2, 1.2, 3)


_BURST_SQL = f"""WITH RECURSIVE {b_sql()}, d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY series ORDER BY k)) AS d, row_number() OVER (PARTITION BY series ORDER BY k) AS i FROM b),
n AS (
  SELECT series, k, i, round(x, 9) AS x, round(CASE WHEN i > 2 AND count(x) OVER w >= 10 THEN quantile_cont(x, 0.5) OVER w END, 9) AS base,
    round(CASE WHEN i > 2 AND count(d) OVER w >= 10 THEN quantile_cont(d, 0.5) OVER w * (1.4826 / sqrt(2.0)) END, 9) AS sd FROM d WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 59 PRECEDING AND 2 PRECEDING)
), o AS (SELECT *, coalesce(x IS NOT NULL AND base IS NOT NULL AND sd > 0, false) AS seen FROM n),
q AS (SELECT *, seen AND (x - base) / sd >= 0.5 AS warm, seen AND (x - base) / sd >= 2 AND x - base >= 2 * sd AS hot FROM o),
v AS (SELECT *, CASE WHEN warm THEN max(CASE WHEN NOT warm THEN i ELSE 0 END) OVER (PARTITION BY series ORDER BY i) + 1 END AS f FROM q),
g AS (SELECT v.*, u.k AS s, u.base AS base0, u.sd AS sd0 FROM v LEFT JOIN v u ON v.hot AND u.series = v.series AND u.i = v.f),
walk AS (
  SELECT series, 0::BIGINT AS i, NULL::BIGINT AS s, NULL::DOUBLE AS base, NULL::DOUBLE AS sd, NULL::BIGINT AS alert, NULL::BIGINT AS peak, NULL::DOUBLE AS excess, NULL::DOUBLE AS sigma, NULL::DOUBLE AS fluence, 0 AS below, 0 AS off, NULL::BIGINT AS stop FROM g GROUP BY series
  UNION ALL
  SELECT series, i, s, base, sd, alert, CASE WHEN grows AND (excess IS NULL OR x - base > excess) THEN k ELSE peak END,
    CASE WHEN grows AND (excess IS NULL OR x - base > excess) THEN x - base ELSE excess END, CASE WHEN grows AND (excess IS NULL OR x - base > excess) THEN (x - base) / sd ELSE sigma END,
    CASE WHEN grows THEN fluence + (x - base) * 600.0 ELSE fluence END, CASE WHEN NOT grows THEN below WHEN (x - base) / sd < 0.5 THEN below + 1 ELSE 0 END, CASE WHEN seen THEN 0 ELSE off + 1 END,
    CASE WHEN s IS NULL THEN NULL WHEN k - s >= 60 THEN k WHEN NOT seen AND off >= 1 THEN k WHEN grows AND (x - base) / sd < 0.5 AND below >= 1 THEN k END
  FROM (SELECT *, coalesce(s IS NOT NULL AND k - s < 60 AND seen, false) AS grows FROM (
    SELECT g.series, g.i, g.k, g.x, g.seen,
      CASE WHEN w.opened THEN w.s ELSE g.s END AS s, CASE WHEN w.opened THEN w.base ELSE g.base0 END AS base, CASE WHEN w.opened THEN w.sd ELSE g.sd0 END AS sd,
      CASE WHEN w.opened THEN w.alert ELSE g.k + 1 END AS alert, CASE WHEN w.opened THEN w.peak ELSE g.k END AS peak, CASE WHEN w.opened THEN w.excess WHEN g.k - g.s >= 60 THEN '-inf'::DOUBLE END AS excess,
      CASE WHEN w.opened THEN w.sigma ELSE 0 END AS sigma, CASE WHEN w.opened THEN w.fluence ELSE 0 END AS fluence, CASE WHEN w.opened THEN w.below ELSE 0 END AS below, CASE WHEN w.opened THEN w.off ELSE 0 END AS off
    FROM (SELECT *, s IS NOT NULL AND stop IS NULL AS opened FROM walk) w JOIN g ON g.series = w.series AND g.i = w.i + 1))
), ev AS (
  SELECT series, s AS start, peak, stop, alert, excess, sigma, fluence FROM walk WHERE stop IS NOT NULL
  UNION ALL SELECT series, s, peak, l.k, alert, excess, sigma, fluence FROM walk JOIN (SELECT series, max(i) AS i, max(k) AS k FROM g GROUP BY series) l USING (series, i) WHERE s IS NOT NULL AND stop IS NULL
), r AS (SELECT *, sum(coalesce((start - before) * 600 > 1200, true)::INT) OVER (PARTITION BY series ORDER BY stop) AS run FROM (SELECT *, lag(stop) OVER (PARTITION BY series ORDER BY stop) AS before FROM ev))
SELECT series, arg_min(start, stop) AS start, arg_max(peak, (excess, -stop)) AS peak, max(stop) AS stop, arg_min(alert, stop) AS alert, round(max(excess), 6) + 0.0 AS excess, round(arg_max(sigma, (excess, -stop)), 6) + 0.0 AS sigma, round(sum(fluence), 6) + 0.0 AS fluence
FROM r GROUP BY series, run"""


@query(_BURST_SQL)
def hard_bursts(spark, sf_dir):
    from gapline.operators.windows import background_noise

    g = rounded(background_noise(binned(spark, sf_dir), 600, 36000, 1200))
    out = detect.bursts(g, 600.0, need=1, least=2.0, end=0.5, merge=1200, longest=36000)
    return out.select("series", "start", "peak", "stop", "alert", *[(F.round(c, 6) + 0.0).alias(c) for c in ("excess", "sigma", "fluence")])


_BUILT = """SELECT c.series, c.n, c.lo, c.hi, c.p, g.x AS px, g.low AS pl FROM (SELECT c.series, c.n, c.lo, c.hi, arg_max(g.k, (g.x - g.low, -g.k)) AS p FROM {0} c JOIN g ON g.series = c.series AND g.k BETWEEN c.lo AND c.hi - 1 AND g.x IS NOT NULL GROUP BY ALL) c JOIN g ON g.series = c.series AND g.k = c.p"""
_ENDS = """SELECT f.series, f.n, coalesce(max(g.k) FILTER (g.k < f.lo) + 1, any_value(z.a)) AS start, f.p AS peak, greatest(f.hi, least(coalesce(min(g.k) FILTER (g.k >= f.hi), any_value(z.z)), any_value(z.z))) AS stop, f.px, f.pl
  FROM {0} f JOIN z ON z.series = f.series LEFT JOIN g ON g.series = f.series AND ((g.k < f.lo AND NOT coalesce(g.x > f.pl + 0.1 * (f.px - f.pl), false)) OR (g.k >= f.hi AND NOT coalesce(g.x > f.pl + 0.5 * (f.px - f.pl), false)))
  GROUP BY f.series, f.n, f.lo, f.hi, f.p, f.px, f.pl"""
_THRESHOLD_SQL = f"""WITH RECURSIVE {b_sql()}, g AS (
  SELECT series, k, round(x, 9) AS x, greatest(round(avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), 9), 1e-9) AS low FROM b
), z AS (SELECT series, min(k) AS a, max(k) AS z FROM g GROUP BY series),
h AS (SELECT *, k - row_number() OVER (PARTITION BY series ORDER BY k) AS run FROM g WHERE x >= 1.4 * low AND x - low >= 4 * sqrt(low / 2.0)),
i AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY min(k)) AS n, min(k) AS lo, max(k) + 1 AS hi FROM h GROUP BY series, run),
j AS ({_BUILT.format("i")}), ev AS ({_ENDS.format("j")}),
walk AS (
  SELECT series, n, start, peak, stop, px, pl, false AS joined FROM ev WHERE n = 1
  UNION ALL
  (WITH y AS (SELECT ev.*, w.start AS ws, w.stop AS we, ev.start - w.stop <= 2 AS joins FROM walk w JOIN ev ON ev.series = w.series AND ev.n = w.n + 1),
    m AS (SELECT series, n, ws AS lo, greatest(we, stop) AS hi FROM y WHERE joins), f AS ({_BUILT.format("m")}), t AS ({_ENDS.format("f")})
   SELECT series, n, start, peak, stop, px, pl, false FROM y WHERE NOT joins UNION ALL SELECT series, n, start, peak, stop, px, pl, true FROM t)
), r AS (SELECT *, lead(joined, 1, false) OVER (PARTITION BY series ORDER BY n) AS goes FROM walk)
SELECT series, start, peak, stop, round(px, 9) + 0.0 AS peak_value, round(pl, 9) + 0.0 AS background, round(px - pl, 9) + 0.0 AS excess, ((peak - start) * 2.0)::DOUBLE AS rise_s, ((stop - start) * 2.0)::DOUBLE AS duration_s FROM r WHERE NOT goes"""


@query(_THRESHOLD_SQL)
def threshold_events(spark, sf_dir):
    from gapline.operators.windows import causal_mean

    g = rounded(causal_mean(binned(spark, sf_dir), 36, "background"))
    return rounded(detect.threshold_events(g, 2.0, merge=2).select("series", "start", "peak", "stop", "peak_value", "background", "excess", "rise_s", "duration_s"))


@query(None)
def power_law_fits(spark, sf_dir):
    from .grid_queries import _EDGES

    edges = spark.createDataFrame([(i, _EDGES[i], _EDGES[i + 1]) for i in range(14)], "bin int, bin_lo double, bin_hi double")
    n = physics.histogram(samples(spark, sf_dir), "x", _EDGES, ["series"])
    every = n.select("series").distinct().join(F.broadcast(edges))  # 14 rows
    return rounded(physics.power_law(every.join(n, ["series", "bin"], "left").fillna(0, ["n"])))


@query(None)
def temperature_fits(spark, sf_dir):
    from .grid_queries import _EDGES

    edges = spark.createDataFrame([(i, _EDGES[i], _EDGES[i + 1]) for i in range(14)], "bin int, bin_lo double, bin_hi double")
    n = physics.histogram(samples(spark, sf_dir), "x", _EDGES, ["series"])
    every = n.select("series").distinct().join(F.broadcast(edges))  # 14 rows
    return rounded(physics.temperature(every.join(n, ["series", "bin"], "left").fillna(0, ["n"])))


@query(None)
def adaptive_bins(spark, sf_dir):
    i = samples(spark, sf_dir)
    events = active(spark, sf_dir).select("series", "event", (F.col("start") * 3600).alias("start"), (F.col("stop") * 3600 + 3599).alias("stop"))
    s = temporal.slices(events, i, 0, 0, 1 << 15)
    per = s.groupBy(F.struct("series", "event").cast("string").alias("event"), F.floor(F.col("t") / 60).alias("k")).agg(F.sum("x").alias("net"))
    return rounded(physics.adaptive_bins(per, 150.0, 1, 1))
