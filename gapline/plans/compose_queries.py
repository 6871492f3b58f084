"""Compositions over the driver's tables: matching, segments, targets, reports, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import scalars, spectra
from gapline.operators import activity, calibrate, detect, labels, physics, reports, scoring, segments, temporal, windows
from gapline.sources import fits
from gapline.sources.tables import table

from .base import E_SQL, S_SQL, STEP, a_sql, active, b_sql, binned, r_sql, rounded, samples, scores
from .event_queries import _pair, _roles, _spans
from .registry import query

A = a_sql()
_P = f"{E_SQL}, l AS (SELECT t, us, x, id FROM e WHERE series = 'click'), r AS (SELECT t, us, x, id FROM e WHERE series = 'error')"
_NEAR = "n AS (SELECT l.id, l.us, l.x, r.x AS v, abs(l.us - r.us) AS d, row_number() OVER (PARTITION BY l.id ORDER BY abs(l.us - r.us), r.us, CASE WHEN r.us <= l.us THEN -r.x ELSE r.x END) AS q FROM l JOIN r ON r.us BETWEEN l.us - 7200000000 AND l.us + 7200000000)"


@query(f"WITH {_P}, {_NEAR} SELECT l.id, n.v AS nearest_x, n.d AS distance FROM l LEFT JOIN n ON n.id = l.id AND q = 1")
def peak_match(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return temporal.nearest(a, b, ["x"], 86_400_000_000, t="us", most=7_200_000_000).select("id", "nearest_x", "distance")


@query(f"""WITH {_P}, {_NEAR}, p AS (SELECT log10(x) AS x, log10(v) AS y FROM n WHERE q = 1 AND x > 0 AND v > 0 AND us < 1705795200000000),
b AS (SELECT floor(x / 0.2)::BIGINT AS b, count(*) AS n, quantile_cont(x, 0.5) AS kx, quantile_cont(y, 0.5) AS ky FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT round(kx, 9) + 0.0 AS x, round(max(ky) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS y, n FROM b""")
def peak_correction(spark, sf_dir):
    a, b = (d.select("series", F.col("us").alias("t"), F.col("x").alias("value")) for d in _pair(spark, sf_dir))
    return rounded(calibrate.peak_correction(a, b, 86_400_000_000, 7_200_000_000, 0.2, 5, F.col("t") < 1_705_795_200_000_000))


@query(f"WITH {E_SQL} SELECT a.id, b.id AS other, b.x FROM e a JOIN e b ON a.us = b.us AND a.series = 'click' AND a.\"user\" = b.\"user\"")
def exact_times(spark, sf_dir):
    e = samples(spark, sf_dir)
    side = lambda d, n: d.select(F.col("user").alias("series"), (F.col("us") / 1_000_000).alias("t"), F.col("id").alias(n), *(["x"] if n == "other" else []))
    return temporal.exact(side(e.where("series = 'click'"), "id"), side(e, "other")).select("id", "other", "x")


@query(f"WITH {E_SQL} SELECT id, series FROM e WHERE EXISTS (SELECT 1 FROM e v WHERE v.\"user\" = e.\"user\" AND v.series = 'error' AND v.t // 86400 = e.t // 86400) AND e.series <> 'error'")
def flares_on_days(spark, sf_dir):
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    days = e.where("kind = 'error'").select("series", F.floor(F.col("t") / 86400).alias("day"))
    return temporal.on_days(e.where("kind <> 'error'"), days).select("id", F.col("kind").alias("series"))


@query(f"""WITH {b_sql(3600, 'h')}, z AS (SELECT series, max(k) AS z FROM h GROUP BY 1)
SELECT e.id, round_even(e.t / 3600.0, 0)::BIGINT AS k, round(h.x, 9) + 0.0 AS x, h.k IS NULL OR e.t + 7200 > z * 3600 AS pending FROM e JOIN z USING (series) LEFT JOIN h ON h.series = e.series AND h.k = round_even(e.t / 3600.0, 0)::BIGINT""")
def settled_steps(spark, sf_dir):
    p = samples(spark, sf_dir).select("series", "id", F.col("t").alias("origin"))
    return rounded(temporal.settled_steps(p, binned(spark, sf_dir, 3600).select("series", "k", "x"), 3600, 7200).select("id", "k", "x", "pending"))


_HARD = """WITH _E_, g AS (SELECT "user" AS series, id AS event, t AS start, t + 20000 AS peak, t + 60000 AS stop, x FROM e WHERE series = 'click'), b AS (SELECT "user" AS series, id AS hard, t AS start, t + 5000 AS peak FROM e WHERE series = 'error'),
sh AS (SELECT unnest([-200000, 0, 200000]) AS shift), j AS (SELECT g.event, shift, b.hard, row_number() OVER (PARTITION BY g.event, shift ORDER BY abs(b.peak + shift - g.peak), b.peak, b.hard) AS q
  FROM g, sh, b WHERE b.series = g.series AND b.peak + shift BETWEEN g.start - 30000 AND g.peak + 30000 AND b.start + shift BETWEEN g.start - 30000 AND g.peak),
f AS (SELECT g.event, g.x, sh.shift, j.hard FROM g CROSS JOIN sh LEFT JOIN j ON j.event = g.event AND j.shift = sh.shift AND j.q = 1)""".replace("_E_", E_SQL)


def _hard(spark, sf_dir):
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    truth = e.where("kind = 'click'").select("series", F.col("id").alias("event"), F.col("t").alias("start"), (F.col("t") + 20000).alias("peak"), (F.col("t") + 60000).alias("stop"), "x")
    hard = e.where("kind = 'error'").select("series", F.col("id").alias("hard"), F.col("t").alias("start"), (F.col("t") + 5000).alias("peak"))
    return temporal.hard_for(truth, hard, 1 << 17, "rise", 30000, 30000, (-200000, 0, 200000))


@query(_HARD + " SELECT event, shift, hard FROM f")
def hard_matches(spark, sf_dir):
    return _hard(spark, sf_dir).select("event", "shift", "hard")


@query(_HARD + """, r AS (SELECT (x >= 50)::INT + (x >= 100)::INT AS cls, shift, avg((hard IS NOT NULL)::INT) AS recall FROM f GROUP BY ALL),
w AS (SELECT cls, max(recall) FILTER (shift = 0) AS recall, avg(recall) FILTER (shift <> 0) AS chance FROM r GROUP BY cls) SELECT cls, round(recall, 9) + 0.0 AS recall, round(chance, 9) + 0.0 AS chance, round(recall - chance, 9) + 0.0 AS gain FROM w""")
def recall_over_chance(spark, sf_dir):
    found = _hard(spark, sf_dir).select("shift", labels.bucket(F.col("x"), [50.0, 100.0]).alias("cls"), F.col("hard").isNotNull().alias("hit"))
    return rounded(reports.gain_over_chance(reports.recall(found)))


@query(f"""WITH {A} SELECT series, event, start, peak, stop, 'low' AS band, round(peak_value - peak_value / 3, 9) + 0.0 AS excess, round(greatest(peak_value / 3, 1e-9), 9) + 0.0 AS background,
round((peak_value - peak_value / 3) * 60 / sqrt(greatest(peak_value / 3 * 60, 1)), 9) + 0.0 AS sigma FROM a""")
def rises_as_bursts(spark, sf_dir):
    a = active(spark, sf_dir).select("series", "event", "start", "peak", "stop", "peak_value", (F.col("peak_value") / 3).alias("start_value"))
    return rounded(detect.as_bursts(a, "low"))


@query("""WITH f AS (SELECT l_returnflag AS series, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS gain, regr_intercept(l_extendedprice, l_quantity) AS "offset" FROM lineitem GROUP BY 1)
SELECT f.series, f.n, round(gain, 4) + 0.0 AS gain, round("offset", 4) + 0.0 AS "offset", round(max(abs(l_extendedprice - gain * l_quantity - "offset")), 4) + 0.0 AS residual FROM f JOIN lineitem ON l_returnflag = f.series GROUP BY ALL""")
def gain_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_quantity").cast("double").alias("channel"), F.col("l_extendedprice").cast("double").alias("energy"))
    out = detect.gain(li)
    return out.select("series", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("gain", "offset", "residual")])


@query("SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS smoothed FROM orders")
def smoothed_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("score"))
    return windows.smoothed_score(o, 3, order="o_orderkey", by="o_custkey").select("o_custkey", "o_orderkey", (F.round("smoothed", 6) + 0.0).alias("smoothed"))


_SEG = f"""WITH {b_sql()}, c AS (SELECT k, x, n FROM b0 WHERE series = 'click'), d AS (SELECT k, x, n FROM b0 WHERE series = 'error'),
cr AS (SELECT k, k - lag(k) OVER (ORDER BY k) AS g FROM c), cp AS (SELECT min(k) AS a, max(k) AS z FROM (SELECT k, sum((g IS NULL OR g > 6)::INT) OVER (ORDER BY k) AS run FROM cr) GROUP BY run),
dr AS (SELECT k, k - lag(k) OVER (ORDER BY k) AS g FROM d), dp AS (SELECT min(k) AS a, max(k) AS z FROM (SELECT k, sum((g IS NULL OR g > 6)::INT) OVER (ORDER BY k) AS run FROM dr) GROUP BY run),
so AS (SELECT 'soft' AS source, a AS segment, unnest(range(a, z + 1)) AS k FROM cp), hl AS (SELECT a AS o, unnest(range(a, z + 1)) AS k FROM dp),
re AS (SELECT o, k, k - row_number() OVER (PARTITION BY o ORDER BY k) AS run FROM hl WHERE k NOT IN (SELECT k FROM so)), hg AS (SELECT o, run, min(k) AS segment FROM re GROUP BY ALL HAVING count(*) >= 2),
al AS (SELECT * FROM so UNION ALL SELECT 'hard', segment, k FROM re JOIN hg USING (o, run)),
sg AS (SELECT 0 AS series, al.k, source, segment, coalesce(c.x, 0) AS soft, (c.k IS NOT NULL)::INT AS soft_mask, coalesce(d.x, 0) AS hard, (d.k IS NOT NULL)::INT AS hard_mask FROM al LEFT JOIN c ON c.k = al.k LEFT JOIN d ON d.k = al.k)"""


def _segments(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("series", F.floor(F.col("t") / STEP).alias("k")).agg(F.avg("x").alias("x"), (F.count("x") / 3.0).alias("coverage"))
    one = lambda kind: rows.where(F.col("series") == kind).withColumn("series", F.lit(0))
    return segments.segments(one("click"), one("error"), 6, 2)


@query(_SEG + f" SELECT series, k, source, segment, {r_sql('soft', 'hard')}, soft_mask, hard_mask FROM sg")
def build_segments(spark, sf_dir):
    return rounded(_segments(spark, sf_dir))


@query(_SEG + f""", z AS (SELECT series, source, segment, max(k) AS last, count(*) AS steps, count(*) * {STEP} / 86400 AS days, avg(soft_mask) AS soft_share, avg(hard_mask) AS hard_share FROM sg GROUP BY ALL)
SELECT series, source, segment, last, steps, {r_sql('days', 'soft_share', 'hard_share')} FROM z""")
def segment_spans(spark, sf_dir):
    return rounded(segments.spans(_segments(spark, sf_dir), float(STEP)))


_PH = """p AS (SELECT series, event, unnest([{'l': 3, 'q': 0, 'a': peak, 'z': stop}, {'l': 1, 'q': 1, 'a': start, 'z': peak - 1}, {'l': 2, 'q': 2, 'a': peak - 1, 'z': peak + 1}]) AS p FROM a),
pj AS (SELECT h.series, h.k, arg_max(p.l, (p.event, p.p.q)) AS phase FROM h JOIN (SELECT series, event, p, p.l AS l FROM p) p ON p.series = h.series AND h.k BETWEEN p.p.a AND p.p.z GROUP BY ALL),
mj AS (SELECT h.series, h.k, arg_max((a.magnitude >= 1.0)::INT + (a.magnitude >= 2.0)::INT + (a.magnitude >= 3.0)::INT, a.event) AS m FROM h JOIN a ON a.series = h.series AND h.k BETWEEN a.start AND a.stop GROUP BY ALL)"""


@query(f"""WITH {A}, {_PH}, g AS (SELECT h.series, h.k, h.x, coalesce(phase, 0)::INT AS phase, coalesce(m, 0)::INT AS magnitude, max(h.k) OVER (PARTITION BY h.series) AS z FROM h LEFT JOIN pj ON pj.series = h.series AND pj.k = h.k LEFT JOIN mj ON mj.series = h.series AND mj.k = h.k),
o AS (SELECT *, lead(CASE WHEN x > 0 THEN log10(x) END, 1) OVER w AS y1, lead(CASE WHEN x > 0 THEN log10(x) END, 3) OVER w AS y3, max((phase > 0)::INT) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS o2, max((phase > 0)::INT) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS o6 FROM g WINDOW w AS (PARTITION BY series ORDER BY k))
SELECT series, k, phase, magnitude, round(y1, 9) + 0.0 AS y_1, x IS NOT NULL AND y1 IS NOT NULL AS valid_1, round(y3, 9) + 0.0 AS y_3, x IS NOT NULL AND y3 IS NOT NULL AS valid_3, o2 AS occurs_2, x IS NOT NULL AND k + 2 <= z AS occurs_valid_2, o6 AS occurs_6, x IS NOT NULL AND k + 6 <= z AS occurs_valid_6 FROM o""")
def all_targets(spark, sf_dir):
    out = segments.targets(binned(spark, sf_dir, 3600), active(spark, sf_dir), [1, 3], [2, 6], 1, (1.0, 2.0, 3.0), 64)
    return rounded(out.select("series", "k", "phase", "magnitude", "y_1", "valid_1", "y_3", "valid_3", "occurs_2", "occurs_valid_2", "occurs_6", "occurs_valid_6"))


_RS = f"""WITH {A}, w AS (SELECT series, event, start - 6 AS start, peak, peak_value FROM a), q AS (SELECT quantile_cont(peak_value, 0.75) AS bar FROM w),
s AS (SELECT series, event, start, peak, peak_value, unnest(range(start + 1, floor(start + (peak - start) * 0.8)::BIGINT + 1, 2)) AS "at" FROM w WHERE start + 1 <= floor(start + (peak - start) * 0.8))"""


@query(_RS + """, m AS (SELECT DISTINCT series, k FROM h WHERE n > 0), c AS (SELECT s.*, (SELECT count(*) FROM m WHERE m.series = s.series AND m.k BETWEEN s.start AND s."at" - 1) AS c FROM s)
SELECT series, event, round(sum(c) / sum("at" - start), 9) + 0.0 AS share FROM c GROUP BY ALL""")
def rise_coverage(spark, sf_dir):
    a = active(spark, sf_dir).withColumn("start", F.col("start") - 6)
    s = labels.rise_samples(a, 1, 2, 0.8).join(a.select("series", "event", F.col("start").alias("onset")), ["series", "event"])
    return rounded(segments.rise_coverage(s, binned(spark, sf_dir, 3600).where("n > 0").select("series", "k"), 64))


@query(_RS + """, t AS (SELECT series || event AS event, peak - "at" AS lead, (peak_value >= bar)::INT AS e FROM s, q), p AS (SELECT event, count(*) AS n FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS samples, (SELECT round(quantile_cont(lead, 0.5), 9) + 0.0 FROM t) AS lead_median, (SELECT max(lead) FROM t) AS lead_max, (SELECT round(avg(e), 9) + 0.0 FROM t) AS positive, count(*) AS events, min(n) AS fewest, max(n) AS most FROM p""")
def rise_summary(spark, sf_dir):
    s = labels.rise_samples(active(spark, sf_dir).withColumn("start", F.col("start") - 6), 1, 2, 0.8)
    return rounded(segments.summary(s.withColumn("event", F.struct("series", "event")), "to_peak"))


@query(f"""WITH {A} SELECT h.series, h.k, EXISTS (SELECT 1 FROM a WHERE a.series = h.series AND h.k BETWEEN a.start - 4 AND a.stop) AS label_c,
coalesce(max(x) OVER (PARTITION BY h.series ORDER BY h.k ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) >= 90, false) AS label_m FROM h""")
def alert_labels(spark, sf_dir):
    return segments.alert_labels(binned(spark, sf_dir, 3600), active(spark, sf_dir), 4, 6, 90.0, 64).select("series", "k", "label_c", "label_m")


_EV = "count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y <> 1)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y <> 1)::DOUBLE AS tn, avg((p - y) ** 2) AS brier, avg(y) AS base"
_SK = "coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0) AS tss, coalesce(2 * (tp * tn - fp * fn) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0), 0) AS hss, coalesce((base * (1 - base) - brier) / nullif(base * (1 - base), 0), 0) AS brier_skill"


@query(f"WITH {S_SQL}, z AS (SELECT source, {_EV} FROM s WHERE y IS NOT NULL GROUP BY source), k AS (SELECT *, {_SK} FROM z) SELECT source, tp, fp, fn, tn, {r_sql('tss', 'hss', 'brier', 'brier_skill')} FROM k")
def evaluation_blocks(spark, sf_dir):
    return rounded(reports.evaluation(scores(spark, sf_dir), "y", "p", 0.5, ("source",)))


@query(f"""WITH {S_SQL}, t AS (SELECT y, 'all' AS arm, p FROM s UNION ALL SELECT y, 'blank', 0.5 FROM s UNION ALL SELECT y, 'half', p / 2 FROM s),
z AS (SELECT arm, {_EV} FROM t WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY arm), k AS (SELECT *, {_SK} FROM z) SELECT arm, tp, fp, fn, tn, {r_sql('tss', 'hss', 'brier', 'brier_skill')} FROM k""")
def modality_ablation(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("blank", F.lit(0.5)).withColumn("half", F.col("p") / 2)
    return rounded(reports.ablation(s, "y", {"all": "p", "blank": "blank", "half": "half"}, 0.5))


_SP = f"""{A}, w AS (SELECT series, event, start, peak, max(peak) OVER (PARTITION BY series ORDER BY peak, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
sp AS (SELECT series, event, greatest(start - 3, coalesce(p + 1, start - 3)) AS start, peak AS stop FROM w WHERE greatest(start - 3, coalesce(p + 1, start - 3)) <= peak)"""


@query(f"""WITH {_SP}, hh AS (SELECT series, k, 'mean' AS arm, x FROM h UNION ALL SELECT series, k, 'count', n * 20.0 FROM h), th AS (SELECT unnest([40.0, 60.0, 80.0, 100.0]::DOUBLE[]) AS threshold), o AS (SELECT arm, th.threshold, hh.series, k, k - lag(k) OVER (PARTITION BY arm, th.threshold, hh.series ORDER BY k) AS g FROM hh, th WHERE x >= th.threshold),
r AS (SELECT *, sum((g IS NULL OR g > 6)::INT) OVER (PARTITION BY arm, threshold, series ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o), p AS (SELECT arm, threshold, series, min(k) AS start, max(k) AS stop FROM r GROUP BY arm, threshold, series, run),
f AS (SELECT arm, threshold, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.series = p.series AND a.start - 30 <= p.stop AND a.stop + 15 >= p.start)) AS f FROM p GROUP BY ALL),
l AS (SELECT arm, threshold, avg((EXISTS (SELECT 1 FROM hh WHERE hh.arm = m.arm AND hh.series = sp.series AND hh.x >= threshold AND hh.k BETWEEN sp.start AND sp.stop))::INT) AS tpr FROM sp, th, (SELECT unnest(['mean', 'count']) AS arm) m GROUP BY ALL),
z AS (SELECT arm, threshold, tpr, coalesce(f, 0) / (SELECT count(*) / 1440 FROM h) AS fpd FROM l LEFT JOIN f USING (arm, threshold)), c AS (SELECT *, threshold = min(threshold) FILTER (fpd <= 10) OVER (PARTITION BY arm) AS chosen FROM z)
SELECT arm, threshold, round(tpr, 9) + 0.0 AS tpr, round(fpd, 9) + 0.0 AS false_per_day FROM c WHERE chosen""")
def equal_alarm_ablation(spark, sf_dir):
    h = binned(spark, sf_dir, 3600).withColumn("count", F.col("n") * 20.0)
    return rounded(reports.equal_alarms(h, {"mean": "x", "count": "count"}, [40.0, 60.0, 80.0, 100.0], active(spark, sf_dir), _spans(spark, sf_dir), 10.0), "threshold")


@query("""WITH r AS (SELECT l_returnflag AS cls, CASE WHEN l_linenumber <> 3 THEN l_discount::DOUBLE END AS o, CASE WHEN l_linenumber <> 5 THEN l_tax::DOUBLE END AS p, l_discount::DOUBLE / 2 + 0.01 AS b, l_quantity::DOUBLE AS d FROM lineitem),
f AS (SELECT *, o IS NOT NULL AND p IS NOT NULL AS m FROM r)
SELECT cls, count(*) AS n, count(*) FILTER (m) AS n_with_onset, round(quantile_cont(b, 0.5), 9) + 0.0 AS background, round(quantile_cont(o, 0.5) FILTER (m), 9) + 0.0 AS onset, round(quantile_cont(p, 0.5) FILTER (m), 9) + 0.0 AS peak, round(quantile_cont(o / p, 0.5) FILTER (m AND p <> 0), 9) + 0.0 AS onset_over_peak,
round(avg((o >= 0.8 * p)::INT) FILTER (m), 9) + 0.0 AS share_near_peak, round(avg((o > b)::INT) FILTER (m), 9) + 0.0 AS share_over_background, round(quantile_cont(d, 0.5), 9) + 0.0 AS onset_to_peak FROM f GROUP BY cls""")
def onset_statistics(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cls"), F.when(F.col("l_linenumber") != 3, d("l_discount")).alias("hardness_onset"), F.when(F.col("l_linenumber") != 5, d("l_tax")).alias("hardness_peak"), (d("l_discount") / 2 + 0.01).alias("hardness_background"), d("l_quantity").alias("onset_to_peak"))
    return rounded(reports.onset_statistics(li))


@query("""WITH r AS (SELECT l_discount::DOUBLE * 10 AS r, l_extendedprice::DOUBLE AS lag FROM lineitem WHERE l_quantity >= 5)
SELECT count(*) AS n, round(quantile_cont(r, 0.5), 9) + 0.0 AS r, round(avg((r > 0.5)::INT), 9) + 0.0 AS share_above_half, round(quantile_cont(lag, 0.25), 6) + 0.0 AS lag_q25, round(quantile_cont(lag, 0.5), 6) + 0.0 AS lag_q50, round(quantile_cont(lag, 0.75), 6) + 0.0 AS lag_q75 FROM r""")
def neupert_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("sigma"), (F.col("l_discount").cast("double") * 10).alias("r"), F.col("l_extendedprice").cast("double").alias("lag"))
    out = reports.neupert_statistics(li)
    return rounded(out.select("n", "r", "share_above_half", *[F.round(c, 6).alias(c) for c in ("lag_q25", "lag_q50", "lag_q75")]))


@query("""WITH r AS (SELECT c_nationkey, avg(c_acctbal) / 1000 AS gain, avg(c_acctbal) / max(c_acctbal) AS relative, quantile_cont(c_acctbal, 0.05) AS low FROM customer GROUP BY 1)
SELECT count(*) AS runs, round(avg(gain), 6) + 0.0 AS gain, round(avg(relative), 6) + 0.0 AS relative, round(stddev_samp(relative), 6) + 0.0 AS relative_sd, count(*) FILTER (low > 0) AS above_zero,
CASE WHEN count(*) FILTER (low > 0) = count(*) AND count(*) >= 3 THEN 'holds' WHEN count(*) FILTER (gain > 0) > count(*) / 2 THEN 'mixed' ELSE 'does not hold' END AS verdict FROM r""")
def repeated_runs(spark, sf_dir):
    b = F.col("c_acctbal").cast("double")
    r = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg(b) / 1000).alias("gain"), (F.avg(b) / F.max(b)).alias("relative"), F.percentile(b, F.lit(0.05)).alias("low"))
    out = reports.repeated_runs(r)
    return out.select("runs", *[(F.round(c, 6) + 0.0).alias(c) for c in ("gain", "relative", "relative_sd")], "above_zero", "verdict")


@query("""WITH e AS (SELECT value AS x, event_type = 'click' AS m FROM events), f AS (SELECT unnest([{'n': 'b', 'v': 10.0}, {'n': 'c', 'v': 50.0}, {'n': 'm', 'v': 150.0}]) AS f)
SELECT f.n AS floor, count(*) AS n, round(avg(m::INT), 9) + 0.0 AS precision, round(count(*) FILTER (NOT m) / 30.0, 9) + 0.0 AS unmatched_a_day FROM e JOIN f ON x >= f.v GROUP BY 1""")
def precision_floors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("x"), (F.col("event_type") == "click").alias("m"))
    return rounded(reports.precision(e, F.col("m"), {n: F.col("x") >= v for n, v in (("b", 10.0), ("c", 50.0), ("m", 150.0))}, 30.0))


@query(f"""WITH {_P}, {_NEAR} SELECT (v >= 50)::INT + (v >= 100)::INT AS cls, count(*) AS n, round(quantile_cont(log10(x) - log10(v), 0.5), 9) + 0.0 AS bias, round(quantile_cont(abs(log10(x) - log10(v)), 0.5), 9) + 0.0 AS error FROM n WHERE q = 1 AND x > 0 AND v > 0 GROUP BY 1""")
def class_agreement(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    near = temporal.nearest(a, b, ["x"], 86_400_000_000, t="us", most=7_200_000_000).where("nearest_x IS NOT NULL")
    return rounded(reports.agreement(near, "x", "nearest_x", labels.bucket(F.col("nearest_x"), [50.0, 100.0])))


@query(f"WITH {E_SQL} SELECT series, t // 600 AS k, max(x) AS top, round(quantile_cont(x, 0.5), 9) + 0.0 AS median, count(x) AS n FROM e GROUP BY ALL")
def mission_overview(spark, sf_dir):
    return rounded(segments.described(samples(spark, sf_dir), F.col("x")), "top")


@query(f"WITH {E_SQL} SELECT series, k * 600 // 86400 AS day, round(count(*) * 600.0 / 86400, 9) + 0.0 AS share FROM (SELECT DISTINCT series, t // 600 AS k FROM e) GROUP BY ALL")
def daily_coverage(spark, sf_dir):
    return rounded(segments.daily_coverage(samples(spark, sf_dir).select("series", F.floor(F.col("t") / 600).alias("k")), 600.0))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # the SQL leaves ties open: of equal rows the one that stands first in the file
    return segments.first_seen(rows, "l_orderkey", [F.col(c) for c in ("l_shipdate", "l_linenumber", "_file", "_at")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH {b_sql(3600, 'h')} SELECT h.series, h.k, round(h.x - p.x, 9) + 0.0 AS d_x FROM h LEFT JOIN h p ON p.series = h.series AND p.k = h.k - 24""")
def day_differences(spark, sf_dir):
    return rounded(activity.lagged(binned(spark, sf_dir, 3600), 24, ["x"], "k").select("series", "k", "d_x"))


@query(f"""WITH {b_sql(3600, 'h')}, f AS (SELECT series, k, x, greatest(0, (k - 3) // 6)::BIGINT AS w FROM h), d AS (SELECT series, k // 24 AS event, k, x - lag(x) OVER (PARTITION BY series ORDER BY k) AS s FROM h)
SELECT series || ':' || event AS event, arg_max(k, (round(s, 9), -k)) AS step, round(max(round(s, 9)), 9) + 0.0 AS slope FROM d WHERE s IS NOT NULL GROUP BY 1""")
def steepest_step(spark, sf_dir):
    h = activity.lagged(binned(spark, sf_dir, 3600), 1, ["x"], "k")
    return rounded(detect.steepest(h.select(F.concat_ws(":", "series", F.floor(F.col("k") / 24)).alias("event"), "k", F.round("d_x", 9).alias("slope"))))


@query("""SELECT event_id, round(value / ((user_id % 7) + 1e-9), 3) + 0.0 AS ratio, round(ln(1 + greatest(value - 20, 0)), 9) + 0.0 AS log1p_x, round(log10(greatest(value - 20, 1e-9)), 9) + 0.0 AS log10_x,
CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE (user_id % 300)::DOUBLE END AS version, CASE WHEN user_id % 4 <> 0 THEN value END AS known FROM events""")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("user_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("V"), (F.col("user_id") % 300).cast("string")))
    nan = F.when(F.col("user_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = e.select("event_id", (F.round(scalars.safe_ratio(F.col("value"), (F.col("user_id") % 7).cast("double")), 3) + 0.0).alias("ratio"), scalars.log1p_floor(F.col("value") - 20).alias("log1p_x"), scalars.log10_floor(F.col("value") - 20).alias("log10_x"), scalars.version_priority(text).alias("version"), scalars.known(nan).alias("known"))
    return rounded(out, "ratio", "version", "known")


@query("SELECT vec_id, label > 2 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS fine FROM embeddings")
def valid_spectra(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", spectra.fine(F.col("embedding"), F.col("label") - 2).alias("fine"))


@query("""WITH p AS (SELECT event_id AS id, 'data/' || user_id || '/' || (CASE WHEN event_id % 3 = 0 THEN 'AL1_SDD2_' || event_id || '.lc.gz' WHEN event_id % 3 = 1 THEN 'AL1_SDD1_' || event_id || '.pi' ELSE 'gti_' || event_id || '.txt' END) AS path FROM events)
SELECT 'data/' || split_part(path, '/', 2) AS product, count(*) FILTER (id % 3 <> 2) AS curves, count(*) FILTER (id % 3 = 2) AS intervals, (count(*) FILTER (id % 3 = 0) > 0)::INT + (count(*) FILTER (id % 3 = 1) > 0)::INT AS detectors FROM p GROUP BY 1""")
def product_files(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("AL1_SDD2_"), F.col("event_id"), F.lit(".lc.gz"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("AL1_SDD1_"), F.col("event_id"), F.lit(".pi"))).otherwise(F.concat(F.lit("gti_"), F.col("event_id"), F.lit(".txt")))
    p = fits.products(e.select(F.concat(F.lit("data/"), F.col("user_id"), F.lit("/"), name).alias("path")))
    size = lambda c: F.size(c).cast("long")
    return p.select("product", size("curves").alias("curves"), size("intervals").alias("intervals"), F.size("detectors").alias("detectors"))


@query("SELECT event_id, sha256(event_type || '|' || user_id || '|') AS digest FROM events")
def forecast_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scoring.fingerprint(F.col("event_type"), F.col("user_id"), F.lit(None).cast("string")).alias("digest"))


@query("""WITH r AS (SELECT user_id AS file, event_type AS band, event_id // 100 AS t, CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END AS rate FROM events), c AS (SELECT file, band, count(*) AS n, min(t) AS t0 FROM r GROUP BY ALL), f AS (SELECT file, arg_min(t0, (-n, band)) AS t0 FROM c GROUP BY 1),
p AS (SELECT r.file, band, round_even((t - t0) / 5.0, 0)::BIGINT AS slot, rate FROM r JOIN f USING (file) WHERE round_even((t - t0) / 5.0, 0) >= 0), l AS (SELECT file, slot, bool_or(rate <> 0) AS live FROM p GROUP BY ALL)
SELECT p.file, p.slot, p.band, count(CASE WHEN live THEN rate END) AS n, round(sum(CASE WHEN live THEN rate END), 6) + 0.0 AS total FROM p JOIN l ON l.file = p.file AND l.slot = p.slot GROUP BY ALL""")
def band_slots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("file"), F.col("event_type").alias("band"), F.floor(F.col("event_id") / 100).alias("t"), F.when(F.col("event_id") % 4 == 0, F.col("value")).otherwise(0.0).alias("rate"), F.lit(0.0).alias("err"))
    out = fits.band_slots(rows, 5.0, ["file"]).groupBy("file", "slot", "band").agg(F.count("rate").alias("n"), (F.round(F.sum("rate"), 6) + 0.0).alias("total"))
    return out.select("file", "slot", "band", "n", "total")


@query(f"""WITH {E_SQL}, p AS (SELECT "user" AS series, id AS event, t AS start, t + 3000 AS peak, t + 60000 AS stop, t + 600 AS alert FROM e WHERE series = 'click'),
v AS (SELECT "user" AS series, id AS event, t AS start, t + 3000 AS peak, t + 60000 AS stop, t + 600 AS alert FROM e WHERE series = 'view'), w AS (SELECT "user" AS series, id AS event, t + 3000 AS peak, t + 600 AS alert FROM e WHERE series = 'error'),
j1 AS (SELECT v.event AS b, v.alert, p.series, p.event, row_number() OVER (PARTITION BY v.event ORDER BY p.start DESC, p.event DESC) AS q FROM v JOIN p ON p.series = v.series AND v.peak BETWEEN p.start - 300 AND p.stop),
k1 AS (SELECT series, event, min(alert) AS alert FROM j1 WHERE q = 1 GROUP BY ALL),
r1 AS (SELECT p.series, p.event, p.start, p.peak, p.stop, least(p.alert, k1.alert) AS alert, CASE WHEN k1.event IS NULL THEN 'click' ELSE 'click+view' END AS bands FROM p LEFT JOIN k1 USING (series, event) UNION ALL SELECT series, event, start, peak, stop, alert, 'view' FROM v WHERE event NOT IN (SELECT b FROM j1)),
j2 AS (SELECT w.event AS b, w.alert, r1.series, r1.event, row_number() OVER (PARTITION BY w.event ORDER BY r1.start DESC, r1.event DESC) AS q FROM w JOIN r1 ON r1.series = w.series AND w.peak BETWEEN r1.start - 300 AND r1.stop), k2 AS (SELECT series, event, min(alert) AS alert FROM j2 WHERE q = 1 GROUP BY ALL)
SELECT r1.series, r1.event, start, peak, stop, least(r1.alert, k2.alert) AS alert, CASE WHEN k2.event IS NULL THEN bands ELSE bands || '+error' END AS bands FROM r1 LEFT JOIN k2 ON k2.series = r1.series AND k2.event = r1.event""")
def attach_bands(spark, sf_dir):
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    one = lambda kind: e.where(F.col("kind") == kind).select("series", F.col("id").alias("event"), F.col("t").alias("start"), (F.col("t") + 3000).alias("peak"), (F.col("t") + 60000).alias("stop"), (F.col("t") + 600).alias("alert"), F.lit(kind).alias("band"))
    return temporal.attach_bands(one("click"), [("view", one("view"), True), ("error", one("error"), False)], 1 << 16)


@query(f"""WITH {b_sql(3600, 'h')}, d AS (SELECT series, k, x, x * 0.5 AS bg, CASE WHEN n > 1 THEN sqrt(x) END AS sd, n FROM h), f AS (SELECT *, greatest(sd, sqrt(greatest(bg, 0) / (1.0 * greatest(n, 1e-3)))) AS s FROM d), o AS (SELECT *, n > 0 AND x IS NOT NULL AND s > 0 AS o FROM f)
SELECT 0 AS series, k, round(sum(x) FILTER (o), 6) + 0.0 AS x, round(sum(bg) FILTER (o), 6) + 0.0 AS background, round(sqrt(sum(s * s) FILTER (o)), 6) + 0.0 AS noise, coalesce(bool_and(round(x - bg - 2.0 * s, 9) >= 0) FILTER (o), false) AS together, coalesce(string_agg(DISTINCT CASE WHEN o THEN series END, '+' ORDER BY CASE WHEN o THEN series END), '') AS detectors FROM o GROUP BY k""")
def coincident_bands(spark, sf_dir):
    h = binned(spark, sf_dir, 3600).select(F.col("series").alias("detector"), F.lit(0).alias("series"), "k", "x", (F.col("x") * 0.5).alias("background"), F.when(F.col("n") > 1, F.sqrt("x")).alias("noise"), F.col("n").cast("double").alias("coverage"))
    out = detect.coincident(h)
    return out.select("series", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "background", "noise")], "together", "detectors")


@query(f"""WITH {b_sql(600, 'm')}, l AS (SELECT unnest([0, 1, 3, 6]) AS lag), p AS (SELECT a.series, lag, a.n::DOUBLE AS a, b.n::DOUBLE AS b FROM m a, l, m b WHERE b.series = a.series AND b.k = a.k + lag)
SELECT series, lag, count(*) AS pairs, round(covar_pop(a, b), 9) + 0.0 AS covariance, round(CASE WHEN avg(a) > 0 THEN covar_pop(a, b) / avg(a) END, 9) + 0.0 AS over_mean FROM p GROUP BY ALL""")
def lag_covariance(spark, sf_dir):
    return rounded(physics.lag_covariance(binned(spark, sf_dir), [0, 1, 3, 6]))


@query(f"WITH {b_sql(600, 'm')} SELECT series, k // 24 AS second, round(count(*) FILTER (n > 0) / 24, 9) + 0.0 AS share, sum(n)::BIGINT AS counts FROM m GROUP BY ALL")
def tick_occupancy(spark, sf_dir):
    return rounded(physics.occupancy(binned(spark, sf_dir), 24))


@query(f"""WITH {b_sql(3600, 'h')}, r AS (SELECT series, k, x, lag(x) OVER w AS p, avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS c FROM h WINDOW w AS (PARTITION BY series ORDER BY k)),
v AS (SELECT unnest([{{'f': 'persistence', 'e': p - x}}, {{'f': 'mean', 'e': c - x}}]) AS v FROM r WHERE x IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL)
SELECT v.f AS forecast, count(*) AS n, round(sqrt(avg(v.e * v.e)), 9) + 0.0 AS rmse, round(avg(v.e), 9) + 0.0 AS bias FROM v GROUP BY 1""")
def reference_forecasts(spark, sf_dir):
    from gapline.operators import frames

    h = binned(spark, sf_dir, 3600)
    rows = frames.framed(h, "k", 24, 0, lambda w: {"p": F.first("x").over(w.rangeBetween(-1, -1)), "c": F.avg("x").over(w.rangeBetween(-23, -1))})
    return rounded(reports.references(rows, "x", {"persistence": "p", "mean": "c"}))


@query(f"""WITH {S_SQL}, b AS (SELECT source, y, p, p / 2 + 0.25 AS q FROM s WHERE y IS NOT NULL AND p IS NOT NULL), z AS (SELECT source, count(*) AS n, avg((p - y) ** 2) AS before, avg((q - y) ** 2) AS after, avg(y) AS b FROM b GROUP BY 1)
SELECT source, n, round(before, 9) + 0.0 AS before, round(after, 9) + 0.0 AS after, round(coalesce((b * (1 - b) - after) / nullif(b * (1 - b), 0), 0), 9) + 0.0 AS skill FROM z""")
def calibration_report(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("q", F.col("p") / 2 + 0.25)
    return rounded(reports.calibration_report(s, "y", "p", "q", ("source",)))


@query("""SELECT l_returnflag, floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) + 0.0 AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) + 0.0 AS q75 FROM lineitem GROUP BY ALL HAVING count(*) >= 100""")
def binned_medians(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    out = reports.binned_medians(li, "x", "y", 5.0, 100, ("l_returnflag",))
    return out.select("l_returnflag", "bin", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("q25", "q50", "q75")])


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v, l_quantity::DOUBLE AS e FROM lineitem WHERE l_quantity > 0) SELECT l_returnflag, count(*) AS n, round(sum(v / (e * e)) / sum(1 / (e * e)), 6) + 0.0 AS mean, round(sqrt(1 / sum(1 / (e * e))), 9) + 0.0 AS error FROM r GROUP BY 1""")
def weighted_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"), F.col("l_quantity").cast("double").alias("e"))
    out = reports.weighted_mean(li, "v", "e", ("l_returnflag",))
    return out.select("l_returnflag", "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("error", 9) + 0.0).alias("error"))


@query(f"""WITH {S_SQL}, t AS (SELECT source, round(avg(p), 3) AS threshold FROM s GROUP BY 1), z AS (SELECT source, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y <> 1) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y <> 1) AS tn FROM s JOIN t USING (source) GROUP BY ALL)
SELECT source, threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0), 9) + 0.0 AS tss, round(coalesce(2 * (tp * tn - fp * fn) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0), 0), 9) + 0.0 AS hss FROM z""")
def frozen_thresholds(spark, sf_dir):
    s = scores(spark, sf_dir)
    t = s.groupBy("source").agg(F.round(F.avg("p"), 3).alias("threshold"))
    return rounded(reports.frozen(s, t, "y", "p", "source"), "threshold")


@query(f"""WITH {_P}, g AS (SELECT unnest(range((SELECT min(t) // 600 FROM l), (SELECT max(t) // 600 FROM l) + 1)) * 600 AS t), m AS (SELECT t, max(x) AS x FROM r GROUP BY t)
SELECT g.t, CASE WHEN g.t - m.t < 3600 THEN m.x END AS flux FROM g ASOF LEFT JOIN m ON g.t >= m.t""")
def flux_on_grid(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    ends = a.agg(F.floor(F.min("t") / 600).alias("a"), F.floor(F.max("t") / 600).alias("z"))
    steps = ends.select(F.lit(0).alias("series"), F.explode(F.sequence("a", "z")).alias("k")).select("series", (F.col("k") * 600).alias("t"))
    return temporal.asof(steps, b.select("series", "t", "x"), ["x"], 1 << 17, 3600, True, names="f_").select("t", F.col("f_x").alias("flux"))


@query(f"""WITH {E_SQL}, v AS (SELECT "user" AS series, id AS event, t AS start, t + 5000 AS peak, t + 60000 AS stop FROM e WHERE series = 'click'), s AS (SELECT "user" AS series, id AS segment, t AS first, t + 90000 AS last FROM e WHERE series = 'view')
SELECT v.series, segment, event, start, peak, stop, least(greatest(floor((start - first) / 600)::BIGINT, 0), 150) AS first, least(greatest(floor((peak - first) / 600)::BIGINT, 0), 150) AS top, least(greatest(ceil((stop - first) / 600)::BIGINT, 0), 150) AS last
FROM v JOIN s ON s.series = v.series AND v.start <= s.last AND v.stop >= s.first""")
def events_on_grids(spark, sf_dir):
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    v = e.where("kind = 'click'").select("series", F.col("id").alias("event"), F.col("t").alias("start"), (F.col("t") + 5000).alias("peak"), (F.col("t") + 60000).alias("stop"))
    s = e.where("kind = 'view'").select("series", F.col("id").alias("segment"), F.col("t").alias("first"), (F.col("t") + 90000).alias("last"))
    return segments.clipped(v, s, 600, 1 << 17)


@query("""WITH p AS (SELECT l_returnflag AS series, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)
SELECT series, count(*) AS n, round(regr_slope(y, x), 9) + 0.0 AS slope, round(regr_intercept(y, x), 9) + 0.0 AS intercept FROM p GROUP BY 1""")
def reference_calibration(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0 AND l_extendedprice > 0").select(F.col("l_returnflag").alias("series"), F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))
    return rounded(calibrate.line(li, "x", "y"))
