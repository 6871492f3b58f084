"""Grids, masks, sources and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import clocks, scalars, spectra
from gapline.operators import grid, masks, metrics, physics
from gapline.sources import resolve
from gapline.sources.tables import table

from .base import DIGITS, E_SQL, STEP, b_sql, binned, r_sql, rounded, samples
from .registry import query


@query(f"""WITH {E_SQL}, g AS (
  SELECT series, t // {STEP} AS k, least(1.0, count(CASE WHEN x >= 1 THEN x END) / 3.0) AS coverage, avg(CASE WHEN x >= 1 THEN x END) AS x, avg(CASE WHEN x >= 5 THEN x END) AS high
  FROM e GROUP BY ALL)
SELECT series, k, CASE WHEN coverage >= 0.2 THEN round(x, {DIGITS}) + 0.0 END AS x, CASE WHEN coverage >= 0.2 THEN round(high, {DIGITS}) + 0.0 END AS high,
  CASE WHEN coverage >= 0.2 THEN round(coverage, {DIGITS}) + 0.0 ELSE 0.0 END AS coverage FROM g""")
def rebin_coverage(spark, sf_dir):
    e = samples(spark, sf_dir)
    return rounded(grid.rebin(e, STEP, {"x": F.when(F.col("x") >= 1, F.col("x")), "high": F.when(F.col("x") >= 5, F.col("x"))}, 3.0))


@query(f"WITH {E_SQL} SELECT series, t // 60 AS k, round(avg(x), {DIGITS}) + 0.0 AS rate, round(avg(x) * 60, {DIGITS}) + 0.0 AS counts, count(x) >= 2 AS valid FROM e GROUP BY ALL")
def minute_average(spark, sf_dir):
    return rounded(grid.minutes(samples(spark, sf_dir), 20))


@query(f"WITH {b_sql()} SELECT series, k, round(x, {DIGITS}) + 0.0 AS x, n FROM b")
def grid_spine(spark, sf_dir):
    return rounded(binned(spark, sf_dir))


@query(f"""WITH {b_sql()}, w AS (SELECT k, max(CASE WHEN series = 'click' THEN x END) AS soft, max(CASE WHEN series = 'error' THEN x END) AS hard FROM b0 WHERE series IN ('click', 'error') GROUP BY k)
SELECT g.k, round(soft, {DIGITS}) + 0.0 AS soft, round(hard, {DIGITS}) + 0.0 AS hard FROM (SELECT unnest(range(min(k), max(k) + 1)) AS k FROM w) g LEFT JOIN w USING (k)""")
def common_grid(spark, sf_dir):
    e = samples(spark, sf_dir).groupBy("series", F.floor(F.col("t") / STEP).alias("k")).agg(F.avg("x").alias("x"))
    return rounded(grid.common_grid({"soft": e.where("series = 'click'"), "hard": e.where("series = 'error'")}))


@query(f"""WITH {b_sql()}, f AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER w AS lk, last_value(x IGNORE NULLS) OVER w AS lx,
  first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER v AS rk, first_value(x IGNORE NULLS) OVER v AS rx FROM b
  WINDOW w AS (PARTITION BY series ORDER BY k), v AS (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, k, n, round(x, {DIGITS}) + 0.0 AS x, round(CASE WHEN x IS NOT NULL THEN x WHEN rk - lk - 1 <= 3 THEN lx + (rx - lx) * (k - lk) / (rk - lk) END, {DIGITS}) + 0.0 AS filled FROM f""")
def gap_interpolate(spark, sf_dir):
    return rounded(grid.interpolate(binned(spark, sf_dir), 3))


@query(f"""WITH {b_sql()}, r AS (SELECT *, k - row_number() OVER (PARTITION BY series ORDER BY k) AS run FROM b WHERE n = 0)
SELECT series, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY series, run HAVING count(*) >= 6""")
def uncovered_runs(spark, sf_dir):
    return grid.uncovered(binned(spark, sf_dir), F.col("n") > 0, 6)


@query(f"""WITH {E_SQL}, f AS (SELECT series, "user" * 1000 + t // 432000 % 1000 AS file, min(t) AS start, min(t) + 20 * "user" AS stop FROM e GROUP BY series, "user", t // 432000),
o AS (SELECT *, max(stop) OVER (PARTITION BY series ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM f)
SELECT series, file, start, stop, sum((far IS NULL OR start > far + 3600)::INT) OVER (PARTITION BY series ORDER BY start, stop ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM o""")
def stitch_sessions(spark, sf_dir):
    f = samples(spark, sf_dir).groupBy("series", "user", F.floor(F.col("t") / 432000).alias("part")).agg(F.min("t").alias("start"))
    return grid.sessions(f.select("series", (F.col("user") * 1000 + F.col("part") % 1000).alias("file"), "start", (F.col("start") + 20 * F.col("user")).alias("stop")), 3600)


@query(f"""WITH {E_SQL}, v AS (SELECT series, t // 3600 AS k, "user" % 5 AS file, ("user" % 3)::DOUBLE AS priority, avg(x) AS x, least(1.0, count(x) / 3.0) AS coverage FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY series, k ORDER BY priority DESC, coverage DESC, file) AS r FROM v WHERE coverage > 0)
SELECT series, k, {r_sql('x', 'coverage')}, priority, file FROM o WHERE r = 1""")
def stitch_priority(spark, sf_dir):
    e = samples(spark, sf_dir)
    rows = e.groupBy("series", F.floor(F.col("t") / 3600).alias("k"), (F.col("user") % 5).alias("file"), (F.col("user") % 3).cast("double").alias("priority")).agg(F.avg("x").alias("x"), F.least(F.lit(1.0), F.count("x") / 3.0).alias("coverage"))
    return rounded(grid.stitch(rows, ["x"]))


@query(f"""WITH {E_SQL}, v AS (SELECT series, t // 3600 AS k, 'd' || ("user" % 2) AS detector, "user" % 7 AS file, avg(x) AS x, least(1.0, count(x) / 3.0) AS coverage FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY series, k, detector ORDER BY coverage DESC, file) AS r FROM v)
SELECT series, k, round(max(CASE WHEN detector = 'd0' THEN x END), {DIGITS}) + 0.0 AS d0_x, round(coalesce(max(CASE WHEN detector = 'd0' THEN coverage END), 0), {DIGITS}) + 0.0 AS d0_coverage,
  round(max(CASE WHEN detector = 'd1' THEN x END), {DIGITS}) + 0.0 AS d1_x, round(coalesce(max(CASE WHEN detector = 'd1' THEN coverage END), 0), {DIGITS}) + 0.0 AS d1_coverage, round(max(coverage), {DIGITS}) + 0.0 AS coverage
FROM o WHERE r = 1 GROUP BY series, k""")
def detector_merge_pivot(spark, sf_dir):
    e = samples(spark, sf_dir)
    rows = e.groupBy("series", F.floor(F.col("t") / 3600).alias("k"), F.concat(F.lit("d"), (F.col("user") % 2).cast("string")).alias("detector"), (F.col("user") % 7).alias("file")).agg(F.avg("x").alias("x"), F.least(F.lit(1.0), F.count("x") / 3.0).alias("coverage"))
    return rounded(grid.merge_detectors(rows, ["d0", "d1"], ["x"]))


@query(f"WITH {b_sql()} SELECT series, k // 6 AS block, sum(n)::BIGINT AS total FROM b GROUP BY ALL HAVING count(*) = 6")
def block_sums(spark, sf_dir):
    return grid.blocks(binned(spark, sf_dir), 6, "n")


@query(f"""WITH {E_SQL}, i AS (SELECT "user" AS series, t AS start, t + 1500 AS stop FROM e)
SELECT DISTINCT series, unnest(range(CAST(ceil(start / 600.0) AS BIGINT), stop // 600 + 1)) AS k FROM i""")
def marked_steps(spark, sf_dir):
    i = samples(spark, sf_dir).select(F.col("user").alias("series"), F.col("t").alias("start"), (F.col("t") + 1500).alias("stop"))
    return grid.marked(i, 600)


@query(f"WITH {E_SQL}, d AS (SELECT DISTINCT series, t // 20 AS k FROM e) SELECT series, strftime(make_timestamp(k * 20000000), '%Y-%m-%d') AS day, count(*) * 20 AS seconds FROM d GROUP BY ALL")
def observed_time(spark, sf_dir):
    return grid.observed_time(samples(spark, sf_dir), 20)


def _spans(spark, sf_dir):
    """A user's other events, and the intervals after their errors."""
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    return e.where("kind <> 'error'"), e.where("kind = 'error'").select("series", F.col("t").alias("start"), (F.col("t") + 30000).alias("stop"))


@query(f"""WITH {E_SQL}, i AS (SELECT "user" AS series, t AS start, t + 30000 AS stop FROM e WHERE series = 'error')
SELECT e."user" AS series, e.id, CASE WHEN NOT m THEN x END AS x, m AS masked FROM (
  SELECT e.*, EXISTS (SELECT 1 FROM i WHERE i.series = e."user" AND e.t >= i.start AND e.t < i.stop) AS m FROM e WHERE series <> 'error') e""")
def interval_mask(spark, sf_dir):
    e, i = _spans(spark, sf_dir)
    return masks.mask_intervals(e, i, ["x"], 1 << 16).select("series", "id", "x", "masked")


@query(f"""WITH {E_SQL}, i AS (SELECT "user" AS series, t AS start, t + 30000 AS stop FROM e WHERE series = 'error')
SELECT "user" AS series, id, x FROM e WHERE series <> 'error' AND EXISTS (SELECT 1 FROM i WHERE i.series = e."user" AND e.t BETWEEN i.start AND i.stop)""")
def good_time(spark, sf_dir):
    e, i = _spans(spark, sf_dir)
    return masks.good_time(e, i, 1 << 16).select("series", "id", "x")


@query(f"""WITH {b_sql()}, d AS (SELECT series, k // 144 AS day, k % 144 AS tod, x FROM b),
m AS (SELECT a.series, a.day, a.tod FROM d a JOIN d b ON a.series = b.series AND a.day = b.day + 1 AND a.tod = b.tod WHERE abs(a.x - b.x) <= 0.3 * greatest(abs(a.x), abs(b.x), 1)),
o AS (SELECT *, tod - lag(tod) OVER (PARTITION BY series, day ORDER BY tod) AS g FROM m), r AS (SELECT *, sum((g IS NULL OR g > 15)::INT) OVER (PARTITION BY series, day ORDER BY tod ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT series, day, min(tod) AS first, max(tod) AS last, count(*) AS n FROM r GROUP BY series, day, run HAVING max(tod) - min(tod) + 1 >= 3""")
def copied_days(spark, sf_dir):
    b = binned(spark, sf_dir)
    return masks.copied_days(b.select("series", F.floor(F.col("k") / 144).alias("day"), (F.col("k") % 144).alias("tod"), "x"), tolerance=0.3, least=3)


@query(f"""WITH {b_sql()}, d AS (SELECT series, k // 144 AS day, k % 144 AS tod, x FROM b)
SELECT a.series, a.day, round(CASE WHEN NOT isnan(corr(log10(a.x), log10(b.x))) THEN corr(log10(a.x), log10(b.x)) END, {DIGITS}) + 0.0 AS r, count(*) AS n FROM d a JOIN d b ON a.day = b.day AND a.tod = b.tod AND b.series = 'view'
WHERE a.series <> 'view' AND a.x > 0 AND b.x > 0 GROUP BY ALL""")
def day_correlation(spark, sf_dir):
    d = binned(spark, sf_dir).select("series", F.floor(F.col("k") / 144).alias("day"), (F.col("k") % 144).alias("tod"), "x")
    return rounded(masks.day_correlation(d.where("series <> 'view'"), d.where("series = 'view'").withColumnRenamed("x", "y")))


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, (l_returnflag = 'N')::INT DESC, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def newest_version(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    version = scalars.version_parts(F.concat(F.lit("v1."), F.col("l_linenumber").cast("string")))
    path = F.struct("l_partkey", "l_suppkey", "l_quantity")
    return resolve.newest(li.withColumn("path", path), ["l_orderkey"], version, (F.col("l_returnflag") == "N").cast("int")).select("l_orderkey", "l_partkey", "l_linenumber")


@query(f"""WITH {E_SQL}, s AS (SELECT "user" AS series, id, t AS start, t + 72000 AS stop FROM e WHERE series = 'click'), p AS (SELECT "user" AS series, id AS path, t % 3 AS version, t AS start, t + 50000 AS stop FROM e WHERE series <> 'click'),
o AS (SELECT s.series, s.id, p.path, least(s.stop, p.stop) - greatest(s.start, p.start) AS overlap, row_number() OVER (PARTITION BY s.series, s.id ORDER BY least(s.stop, p.stop) - greatest(s.start, p.start) DESC, version DESC, path DESC) AS r
  FROM s JOIN p ON s.series = p.series AND s.start < p.stop AND p.start < s.stop)
SELECT series, id, path, overlap::DOUBLE AS overlap FROM o WHERE r = 1""")
def product_best_overlap(spark, sf_dir):
    e = samples(spark, sf_dir).withColumn("kind", F.col("series")).withColumn("series", F.col("user"))
    s = e.where("kind = 'click'").select("series", "id", F.col("t").alias("start"), (F.col("t") + 72000).alias("stop"))
    p = e.where("kind <> 'click'").select("series", F.col("id").alias("path"), (F.col("t") % 3).alias("version"), F.col("t").alias("start"), (F.col("t") + 50000).alias("stop"))
    return resolve.best_overlap(s, p, 1 << 16)


@query(f"""WITH {E_SQL}, r AS (SELECT series, t // 14400 AS flare, ['START', 'PEAK', 'END', 'POST'][1 + id % 4] AS status, t, x AS value, id AS row FROM e),
w AS (SELECT series, flare, arg_min(t, row) FILTER (status = 'START') AS s, arg_max(t, row) FILTER (status = 'PEAK') AS p, arg_max(value, row) FILTER (status = 'PEAK') AS v, arg_min(t, row) FILTER (status = 'END') AS z FROM r GROUP BY ALL),
f AS (SELECT series, flare, coalesce(s, p) AS start, p AS peak, z, v AS value, lead(coalesce(s, p)) OVER (PARTITION BY series ORDER BY p, flare) AS nxt FROM w WHERE p IS NOT NULL)
SELECT series, flare, start, peak, coalesce(z, least(peak + greatest(2 * (peak - start), 600), greatest(nxt, peak + 60))) AS stop, value, z IS NULL AS estimated FROM f""")
def flare_record_pivot(spark, sf_dir):
    e = samples(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, ("START", "PEAK", "END", "POST"))), (F.col("id") % 4 + 1).cast("int"))
    return resolve.flare_list(e.select("series", F.floor(F.col("t") / 14400).alias("flare"), status.alias("status"), "t", F.col("x").alias("value"), F.col("id").alias("row")))


@query(f"""WITH {E_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY series, t // 30 ORDER BY "user" % 3, id) AS r FROM e)
SELECT series, t // 30 AS t, CASE WHEN id % 5 <> 0 AND x > 0 THEN x END AS flux FROM o WHERE r = 1""")
def flux_minutes(spark, sf_dir):
    e = samples(spark, sf_dir)
    return resolve.flux_minutes(e.select("series", F.floor(F.col("t") / 30).alias("t"), F.col("x").alias("flux"), (F.col("id") % 5 == 0).cast("int").alias("flag"), (F.col("user") % 3).alias("file"), F.col("id").alias("row")))


@query(f"""WITH {E_SQL} SELECT t // 3600 AS hour, count(*) AS regions, round(CASE WHEN sum(x) > 0 THEN log10(sum(x)) END, {DIGITS}) + 0.0 AS log_x, max(x) AS max_x
FROM e WHERE id % 9 <> 0 AND abs("user" - 75) <= 70 GROUP BY ALL""")
def region_hourly_rollup(spark, sf_dir):
    e = samples(spark, sf_dir)
    quality = F.when(F.col("id") % 9 == 0, F.lit("0x00000100")).otherwise(F.lit("0x0"))
    return rounded(resolve.region_hours(e, ["x"], ["x"], masks.fine_rows(quality, F.col("user") - 75)), "max_x")


@query("""WITH c AS (SELECT p_partkey, substr('ABCMX', 1 + p_size % 5, 1) || printf('%.1f', 1 + p_partkey % 90 / 10.0) AS cls FROM part)
SELECT p_partkey, cls || '/1N' AS cls, round(log10([1e-8, 1e-7, 1e-6, 1e-5, 1e-4][1 + instr('ABCMX', substr(cls, 1, 1)) - 1] * substr(cls, 2)::DOUBLE), 9) + 0.0 AS log_flux, cls AS again FROM c""")
def class_parse_format(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cls = F.concat(F.substring(F.lit("ABCMX"), F.col("p_size") % 5 + 1, F.lit(1)), F.format_string("%.1f", 1 + F.col("p_partkey") % 90 / 10.0))
    out = p.select("p_partkey", F.concat(cls, F.lit("/1N")).alias("cls"))  # what follows the class is left aside
    flux = scalars.class_flux(F.col("cls"))
    return rounded(out.select("p_partkey", "cls", F.log10(flux).alias("log_flux"), scalars.flux_class(flux).alias("again")))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS again, round(sin(2 * pi() * (epoch_us(ts) // 1000000 % 86400) / 86400), 9) + 0.0 AS sine FROM events""")
def clock_conversions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = clocks.seconds(F.col("ts"))
    text = clocks.to_text(s)
    parsed = clocks.seconds(clocks.parsed(text))
    return rounded(e.select("event_id", parsed.alias("s"), text.alias("again"), clocks.time_of_day(s)[0].alias("sine")))


_ENERGY = "list_transform(range(64), lambda c: CASE WHEN c < 32 THEN 2.0 + c * 0.5 ELSE 18.0 + (c - 32) * 1.0 END)"
_BREAKS = ((0, 2.0, 0.5), (32, 18.0, 1.0))


@query(f"""WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS c, {_ENERGY} AS en FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(c, en), lambda p: CASE WHEN p[2] >= 5 AND p[2] < 25 THEN p[1] ELSE 0 END)) / (1 + label), 9) + 0.0 AS rate FROM c""")
def array_band_rate(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    counts = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    return rounded(v.select("vec_id", spectra.band_rate(counts, spectra.channel_energies(64, _BREAKS), 5, 25, (1 + F.col("label")).cast("double")).alias("rate")))


@query(f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS c, {_ENERGY} AS en FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(c, en), lambda p: p[1] * p[2])) / list_sum(c), 9) + 0.0 AS energy FROM c""")
def array_mean_energy(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return rounded(v.select("vec_id", spectra.mean_energy(F.transform("embedding", lambda x: F.abs(x).cast("double")), spectra.channel_energies(64, _BREAKS)).alias("energy")))


_EDGES = [round(x, 6) for x in physics.energy_edges(1.0, 400.0, 14)]
_BIN_SQL = "CASE " + " ".join(f"WHEN x >= {_EDGES[i]} AND x {'<=' if i == 13 else '<'} {_EDGES[i + 1]} THEN {i}" for i in range(14)) + " END"


@query(f"WITH {E_SQL} SELECT series, {_BIN_SQL} AS bin, count(*) AS n FROM e WHERE {_BIN_SQL} IS NOT NULL GROUP BY ALL")
def energy_histogram(spark, sf_dir):
    return physics.histogram(samples(spark, sf_dir), "x", _EDGES, ["series"])


@query(f"WITH {b_sql(60, 'm')} SELECT series, k, n FROM m")
def tick_counts(spark, sf_dir):
    return physics.tick_counts(samples(spark, sf_dir), F.floor(F.col("t") / 60))


@query(f"WITH {E_SQL} SELECT series, strftime(make_timestamp(t * 1000000), '%Y-%m') AS month, count(*) AS n FROM e GROUP BY ALL")
def monthly_counts(spark, sf_dir):
    return metrics.monthly(samples(spark, sf_dir), "t", ["series"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3""")
def top_k_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return metrics.top_k(o, 3, [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_custkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(big)
