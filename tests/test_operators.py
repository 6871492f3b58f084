"""Expected values of single operators, and the rules with memory against plain walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.functions import scalars
from gapline.operators import alerts, calibrate, detect, frames, grid, labels, masks, metrics, physics, temporal, windows
from gapline.sources import fits, resolve, tables


def series(spark, values, name="a", extra=""):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "series string, k long, x double")


def values(df, *cols, order="k"):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(order).collect()]


def test_sparse_sampling_is_not_diluted(spark):
    df = spark.createDataFrame([("a", t, 150.0, None) for t in range(0, 120, 6)], "series string, t long, x double, y double")
    got = grid.rebin(df, 20, {"x": F.col("x")}, 20 / 6)
    assert {r.x for r in got.collect()} == {150.0}


def test_coverage_is_of_rows(spark):
    df = spark.createDataFrame([("a", t, 1.0 if t % 2 else None, None if t % 2 else 2.0) for t in range(20)], "series string, t long, x double, y double")
    r = grid.rebin(df, 20, {"x": F.col("x"), "y": F.col("y")}, 20).first()
    assert (r.coverage, r.x, r.y) == (1.0, 1.0, 2.0)


def test_occurrence_and_next_on(spark):
    df = series(spark, [0.0] * 10 + [1.0] + [0.0] * 9)
    got = values(windows.occurrence(df, 3, F.col("x") > 0), "occurs")
    assert got[7:11] == [1, 1, 1, 1] and got[5] == 0 and got[14] == 0
    assert values(windows.next_on(df, F.col("x") > 0, chunk=4), "next_on") == [10] * 11 + [None] * 9


def test_causal_mean_and_diff(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert values(windows.causal_mean(df, 3), "mean") == [1.0, 1.5, 1.5, 3.0, 4.5, 5.0]
    assert values(windows.causal_diff(df, 2), "diff") == [0.0, 0.0, -1.0, 2.0, 5.0, 2.0]


def test_class_strings(spark):
    df = spark.createDataFrame([(9.97e-7,), (9.94e-7,), (1.2e-3,), (5e-9,), (None,)], "f double")
    assert [r[0] for r in df.select(scalars.flux_class(F.col("f"))).collect()] == ["C1.0", "B9.9", "X12.0", "", ""]
    back = spark.createDataFrame([("M2.5",), ("c",), ("Q1",)], "c string").select(scalars.class_flux(F.col("c"))).collect()
    assert back[0][0] == pytest.approx(2.5e-5) and back[1][0] == pytest.approx(1e-6) and back[2][0] is None


def test_stitching_prefers_the_newer_version(spark):
    rows = [("a", k, 1.0, 1.0, 1.0, 0) for k in range(10)] + [("a", k, 2.0, 1.0, 2.0, 1) for k in range(3, 7)]
    for data in (rows, rows[::-1]):
        got = grid.stitch(spark.createDataFrame(data, "series string, k long, x double, coverage double, priority double, file int"), ["x"])
        assert values(got, "x") == [1, 1, 1, 2, 2, 2, 2, 1, 1, 1]


def test_episodes_overlaps_and_marks(spark):
    on = {2, 3, 4, 9, 20, 30, 31}
    df = spark.createDataFrame([("a", k, float(k in on)) for k in range(40)], "series string, k long, x double")
    assert values(detect.episodes(df, F.col("x") > 0), "start", "stop", order="start") == [(2, 9), (20, 20), (30, 31)]
    spans = spark.createDataFrame([("a", 5, 10), ("a", 8, 30)], "series string, start long, stop long")
    asked = spark.createDataFrame([("a", 0, 5), ("a", 0, 4), ("a", 29, 40), ("a", 31, 40)], "series string, start long, stop long")
    got = {(r.start, r.stop): r.overlaps for r in temporal.overlapping(asked, spans, 16).collect()}
    assert got == {(0, 5): True, (0, 4): False, (29, 40): True, (31, 40): False}
    assert values(grid.marked(spark.createDataFrame([("a", 61, 180)], "series string, start long, stop long"), 60), "k") == [2, 3]


def test_masks_are_half_open(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in (99, 100, 150, 199, 200, 510, 520)], "series string, t long, x double")
    spans = spark.createDataFrame([("a", 100, 200), ("a", 500, 520)], "series string, start long, stop long")
    assert values(masks.mask_intervals(df, spans, ["x"], 64), "masked", order="t") == [False, True, True, True, False, True, False]


def test_missing_end_and_scores(spark):
    rec = spark.createDataFrame([("g", 1, "START", 0, 1.0, 1), ("g", 1, "PEAK", 600, 2.0, 2), ("g", 2, "START", 900, 1.0, 3), ("g", 2, "PEAK", 1000, 3.0, 4), ("g", 2, "END", 1500, 1.0, 5)], "series string, flare long, status string, t long, value double, row long")
    got = {r.flare: (r.stop, r.estimated) for r in resolve.flare_list(rec).collect()}
    assert got == {1: (900, True), 2: (1500, False)}
    df = spark.createDataFrame([(1, 1)] * 2 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 4, "y int, p int")
    assert metrics.contingency(df, F.col("y") == 1, F.col("p") == 1).first().tss == pytest.approx(2 / 3 - 1 / 5)
    assert metrics.roc_auc(df.withColumn("p", F.lit(0.5)), "y", "p").first().auc == 0.5


def test_onset_needs_an_unbroken_run(spark):
    hot = {20, 21, 22, 23, 24}
    df = spark.createDataFrame([(1, k, 5.0 if k in hot else 0.0) for k in range(40)], "event int, k long, s double")
    assert tuple(detect.causal_onset(df, F.col("s")).first())[1:] == (20, 22)
    assert tuple(detect.causal_onset(df.where("k <> 21"), F.col("s")).first())[1:] == (22, 24)


def test_lag(spark):
    rng = random.Random(1)
    x = [rng.random() for _ in range(60)]
    df = spark.createDataFrame([("a", k, x[k], x[k - 3] if k >= 3 else None) for k in range(60)], "series string, k long, x double, y double")
    assert physics.lagged_correlation(df, "x", "y", 6).first().lag == 3


def test_percentile_pads_with_the_first_value(spark):
    rng = random.Random(2)
    x = [None if rng.random() < 0.2 else round(rng.random() * 100, 3) for _ in range(120)]
    x[0] = 50.0
    got = values(windows.trailing_percentile(series(spark, x), 20, 0.1), "percentile")
    padded = [x[0]] * 19 + x
    for i, g in enumerate(got):
        v = sorted(y for y in padded[i : i + 20] if y is not None)
        at = (len(v) - 1) * 0.1
        lo = math.floor(at)
        assert g == pytest.approx(v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo))


@pytest.mark.parametrize("chunk", [3, 10**6])
def test_chunks_change_nothing(spark, chunk):
    rng = random.Random(3)
    data = [(s, k, float(rng.randrange(9))) for s in "ab" for k in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(data, "series string, k long, x double")
    on = F.col("x") > 5
    total = frames.running(df, [F.col("k")], F.col("x"), "sum", F.floor(F.col("k") / chunk))
    run = frames.runs(df, "k", on, 2, chunk=chunk)
    want, seen = [], {}
    for s, k, x in data:
        seen[s] = seen.get(s, 0) + x
        want.append((s, k, seen[s]))
    assert sorted((r.series, r.k, r["sum"]) for r in total.collect()) == want
    want, last, n = [], {}, {}
    for s, k, x in data:
        if x > 5:
            if s not in last or k - last[s] > 2:
                n[s] = n.get(s, 0) + 1
            last[s] = k
            want.append((s, k, n[s]))
    assert sorted((r.series, r.k, r.run) for r in run.collect()) == want


def test_single_flare(spark):
    bg, peak = 1e-6, 5e-6
    x = [bg] * 60 + [bg + (peak - bg) * (i + 1) / 10 for i in range(10)] + [bg + (peak - bg) * math.exp(-(i + 1) / 20) for i in range(170)]
    e = detect.rise_events(series(spark, x)).collect()
    assert len(e) == 1 and (e[0].start, e[0].peak, e[0].reason) == (59, 69, "decay") and e[0].alert == 64
    assert x[e[0].stop] <= (peak + bg) / 2 < x[e[0].stop - 1]
    flat = [bg + (v - bg) * 0.3 * bg / (peak - bg) for v in x]  # a rise to 1.3 times
    assert detect.rise_events(series(spark, flat)).count() == 0


def plain_rises(x, fits=lambda s, q: True):
    """The rule read minute by minute over the whole grid, gaps counted as they come; `fits` guards a confirmation."""
    ok = lambda i: i < len(x) and x[i] is not None
    rise = lambda i: all(ok(i + j) for j in range(3)) and all(x[i + j] < x[i + j + 1] for j in range(2))
    out, i = [], 0
    while i < len(x):
        if not rise(i):
            i += 1
            continue
        s, p, j, gap, reason = i, i, i + 1, 0, "data_end"
        while j < len(x):
            if not ok(j):
                gap += 1
                if gap > 4:
                    reason = "gap"
                    break
                j += 1
                continue
            gap = 0
            if x[j] > x[p]:
                p = j
            elif rise(j):
                reason = "next_flare"
                break
            elif x[j] <= (x[p] + x[s]) / 2:
                reason = "decay"
                break
            j += 1
        end = j if reason in ("decay", "next_flare") else max(p, max(q for q in range(s, min(j, len(x))) if ok(q)))
        usable = [q for q in range(s, end + 1) if ok(q)]
        hits = [q for q in usable[2:] if x[q] >= 1.4 * x[s] and fits(s, end, q)]
        if hits:
            out.append([s, p, end, hits[0] + 1, reason])
        elif out and s - out[-1][2] <= 1:
            out[-1][2], out[-1][4] = end, reason
            if x[p] > x[out[-1][1]]:
                out[-1][1] = p
        i = max(j, i + 1)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("guard", ["none", "counts", "noise", "both"])
def test_rise_walk_against_a_plain_one(spark, guard):
    rng = random.Random(4)
    x, v = [], 10.0
    for _ in range(900):
        v = max(1.0, v + rng.choice([-3, -1, 1, 2, 3]) + (6 if rng.random() < 0.05 else 0))
        x.append(None if rng.random() < 0.1 else v)
    for i in range(300, 330):
        x[i] = None
    counts = [None if v is None else 4.0 * v for v in x]
    noise = [None if rng.random() < 0.2 else rng.uniform(0.2, 1.2) for _ in x]

    def fits(s, end, q):
        fine = guard not in ("counts", "both") or counts[q] - counts[s] >= 3 * math.sqrt(max(counts[q] + counts[s], 1))
        if guard in ("noise", "both"):
            known = [noise[i] for i in range(s, end + 1) if noise[i] is not None and x[i] is not None]
            sd = noise[s] if noise[s] is not None else max(known) if known else None
            fine = fine and sd is not None and x[q] - x[s] >= 3 * math.sqrt(2) * sd
        return fine

    rows = [("a", i, *v) for i, v in enumerate(zip(x, counts, noise, strict=True))]
    df = spark.createDataFrame(rows, "series string, k long, x double, counts double, noise double")
    use = {c: c for c in ("counts", "noise") if guard in (c, "both")}
    want = plain_rises(x, fits)
    for width in (4096, 7):  # chunks far shorter than a flare
        got = detect.rise_events(df, 3, 1.4, 4, width=width, **use)
        assert sorted((r.start, r.peak, r.stop, r.alert, r.reason) for r in got.collect()) == want and want


def plain_threshold_events(x, bg, dt, factor, sigma, least, share, merge):
    """Threshold events step by step over the whole grid."""
    n = len(x)
    low = [max(b, 1e-9) for b in bg]
    above = [v is not None and v >= factor * b and v - b >= sigma * math.sqrt(b / dt) for v, b in zip(x, low, strict=True)]

    def built(i, j):
        seen = [q for q in range(i, j) if x[q] is not None]
        if not seen:
            return None
        p = max(seen, key=lambda q: (x[q] - low[q], -q))
        top = x[p] - low[p]
        if top <= 0:
            return None
        s, e = i, j
        while s > 0 and x[s - 1] is not None and x[s - 1] > low[p] + 0.1 * top:
            s -= 1
        while e < n - 1 and x[e] is not None and x[e] > low[p] + share * top:
            e += 1
        return s, p, e

    found, i = [], 0
    while i < n:
        j = i
        while j < n and above[j]:
            j += 1
        if j - i >= max(least, 1) and (e := built(i, j)):
            found.append(e)
        i = max(j, i + 1)
    out = []
    for e in found:
        if out and e[0] - out[-1][2] <= merge:
            out[-1] = built(out[-1][0], max(out[-1][2], e[2])) or out[-1]
        else:
            out.append(e)
    return out


def test_threshold_events_against_a_plain_walk(spark):
    rng = random.Random(11)
    x = [20 + rng.gauss(0, 2) for _ in range(700)]
    for at in rng.sample(range(20, 650), 14):
        for i in range(25):
            x[at + i] += 60 * math.exp(-i / rng.uniform(2, 9))
    x = [None if rng.random() < 0.06 or 200 <= i < 212 else v for i, v in enumerate(x)]
    bg = [20.0 + 3 * math.sin(i / 90) for i in range(700)]
    df = spark.createDataFrame([("a", i, v, b) for i, (v, b) in enumerate(zip(x, bg, strict=True))], "series string, k long, x double, background double")
    for merge in (1, 4):
        got = detect.threshold_events(df, 20.0, 1.4, 4.0, 2, 0.5, merge).orderBy("start").collect()
        want = plain_threshold_events(x, bg, 20.0, 1.4, 4.0, 2, 0.5, merge)
        assert [(r.start, r.peak, r.stop) for r in got] == want and len(want) > 5
        assert all(r.stop_t == min(r.stop, 699) * 20 and r.duration_s == (r.stop - r.start) * 20 for r in got)


def plain_bursts(detectors, n, dt, need, least, end, merge, longest, each):
    """The rule read step by step: `detectors` are lists of (rate, background, noise), None where nothing is known."""
    on = lambda d, j: d[j] is not None and None not in d[j] and d[j][2] > 0
    live = [[d for d in detectors if on(d, j)] for j in range(n)]
    total = lambda j: sum(d[j][0] - d[j][1] for d in live[j]) / math.sqrt(sum(d[j][2] ** 2 for d in live[j])) if live[j] else -1e9
    hot = [bool(live[j]) and total(j) >= least and all(d[j][0] - d[j][1] >= each * d[j][2] for d in live[j]) for j in range(n)]
    out, i = [], 0
    while i < n:
        if i < need - 1 or not all(hot[i - q] for q in range(need)):
            i += 1
            continue
        s = i
        while s > 0 and live[s - 1] and total(s - 1) >= end:
            s -= 1
        best, fluence, low, off, j = None, 0.0, 0, 0, i
        while j < n and j - s < longest:
            if not live[j]:
                off += 1
                if off == 2:
                    break
            else:
                off = 0
                base = [d[s] if d[s] is not None else d[j] for d in live[j]]
                ex = sum(d[j][0] - b[1] for d, b in zip(live[j], base, strict=True))
                z = ex / math.sqrt(sum(b[2] ** 2 for b in base))
                fluence += ex * dt
                if best is None or ex > best[0]:
                    best = (ex, z, j)
                low = low + 1 if z < end else 0
                if low == 2:
                    break
            j += 1
        best, stop = best or (-math.inf, 0.0, i), min(j, n - 1)
        if out and (s - out[-1][2]) * dt <= merge:
            a = out[-1]
            peak, ex, z = (a[1], a[4], a[5]) if a[4] >= best[0] else (best[2], *best[:2])
            out[-1] = (a[0], peak, stop, a[3], ex, z, a[6] + fluence)
        else:
            out.append((s, best[2], stop, i + 1, *best[:2], fluence))
        i = stop + 1
    return out


def test_bursts_of_two_detectors_against_a_plain_walk(spark):
    """One detector that stops inside a burst leaves the other one's background alone; chunks are shorter than bursts."""
    rng = random.Random(8)
    n = 400
    detectors = [[(10 + rng.gauss(0, 1), 10 + math.sin(j / 40), 1.0) for j in range(n)] for _ in range(2)]
    for at, size, length in ((20, 6, 20), (90, 4, 12), (104, 9, 6), (200, 8, 90), (330, 12, 5), (380, 7, 20)):
        for d in detectors:
            for j in range(at, min(n, at + length)):
                d[j] = (d[j][0] + size, *d[j][1:])
    for j in [*range(28, 60), *(j for j in range(60, n) if rng.random() < 0.1)]:
        detectors[1][j] = None
    for j in (205, 240, 241, 300):
        detectors[0][j] = detectors[1][j] = None
    rows = [("a", str(i), j, *v) for i, d in enumerate(detectors) for j, v in enumerate(d) if v is not None]
    df = spark.createDataFrame(rows, "series string, detector string, k long, x double, background double, noise double")
    want = plain_bursts(detectors, n, 2.0, 3, 5.0, 1.0, 20, 30, 2.0)
    assert len(want) >= 4 and any(r[2] - r[0] >= 30 for r in want)
    first = want[0]
    assert first[0] == 20 and first[2] >= 40  # not ended by the detector that stopped at 28
    for width in (4096, 5):
        got = detect.bursts(df, 2.0, merge=20, longest=60, detector="detector", width=width).orderBy("start").collect()
        assert [(r.start, r.peak, r.stop, r.alert) for r in got] == [r[:4] for r in want]
        assert [(r.excess, r.sigma, r.fluence) for r in got] == [pytest.approx(r[4:]) for r in want]


def test_fits_with_a_background(spark):
    edges = physics.energy_edges(20, 150, 14)
    rows = [("a", lo, hi, round(1e5 * (lo**-2.5 - hi**-2.5) * 40 + 300), 300.0) for lo, hi in zip(edges, edges[1:], strict=False)]
    kind = "series string, bin_lo double, bin_hi double, n long, bkg double"
    r = physics.power_law(spark.createDataFrame(rows, kind)).first()
    assert r["index"] == pytest.approx(3.5, abs=0.15)
    assert physics.power_law(spark.createDataFrame(rows, kind).drop("bkg")).first()["index"] < r["index"] - 0.2
    shape = lambda lo, hi: math.exp(-(lo + hi) / 2 / 12) * ((lo + hi) / 2) ** -1.5 * (hi - lo)
    rows = [("a", lo, hi, round(1e6 * shape(lo, hi) * 0.5) + 50, 50.0, 0.5) for lo, hi in zip(edges, edges[1:], strict=False)]
    t = physics.temperature(spark.createDataFrame(rows, kind + ", eff double"), slope=1.5).first()
    assert t.kt == pytest.approx(12, abs=0.3) and t.error > 0
    e = spark.range(1).select(physics.silicon_efficiency(F.lit(10.0)).alias("e")).first().e
    assert e == pytest.approx(1 - math.exp(-33.9 * 2.33 * 450e-4))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for kind in ("csv", "json", "parquet"):
        tables.export(df, f"file://{tmp_path}/{kind}", kind)
        back = spark.read.options(header="true", inferSchema="true").format(kind).load(f"file://{tmp_path}/{kind}")
        assert sorted((r.k, r.v) for r in back.collect()) == [(1, "a"), (2, None)]
        with pytest.raises(Exception, match="exists"):
            tables.export(df, f"file://{tmp_path}/{kind}", kind)
    assert tables.csv(spark, f"file://{tmp_path}/csv", "k long, v string").count() == 2
    with pytest.raises(ValueError):
        tables.export(df, "x", "xlsx")


def test_outside_lists_and_light_curves(spark):
    rows = [("2024-01-01 00:00:00", "2024-01-01 00:10:00", None, "M2.5/1N"), ("2024-01-02 00:00:00", None, None, "C1")]
    got = resolve.outside_events(spark.createDataFrame(rows, "Begin_Time string, max_time string, end_time string, goes_class string")).collect()
    assert len(got) == 1 and got[0].stop == got[0].peak == 1704067800 and got[0].flux == pytest.approx(2.5e-5)
    counts = spark.createDataFrame([("p", float(i), [0.0] * 41 + [1.0, float(i)]) for i in range(5)], "path string, TSTART double, COUNTS array<double>")
    curve = spark.createDataFrame([(float(i), 1.0 + i) for i in range(5)], "TIME double, COUNTS double")
    r = fits.consistency(counts, curve).first()
    assert (r.most, r.exact, r.n) == (0.0, True, 5)
    assert not fits.consistency(counts, curve.withColumn("COUNTS", F.col("COUNTS") + 1)).first().exact


def test_closed_streams_hold_late_rows_and_all_windows(spark, tmp_path):
    from gapline.streaming import events as stream

    rows = spark.createDataFrame([("a", t * 1_000_000, float(t)) for t in (3, 1, 700, 650, 1300, 40)], "series string, us long, x double")
    s = stream.closed(spark, rows, f"file://{tmp_path}/in").withColumn("ts", F.timestamp_micros("us"))
    out = stream.drained(stream.tumbling(s), f"file://{tmp_path}/w").where("series IS NOT NULL")
    assert sorted((r.start.timestamp() % 86400 // 600, r.n) for r in out.collect()) == [(0, 3), (1, 2), (2, 1)]


def test_bursts_and_fits(spark):
    rng = random.Random(5)
    x = [70 + rng.gauss(0, 8) for _ in range(600)]
    for i in range(300, 312):
        x[i] += 200
    df = windows.background_noise(series(spark, x), 20)
    got = detect.bursts(df, 20.0).collect()
    assert len(got) == 1 and 298 <= got[0].start <= 301 and 310 <= got[0].stop <= 314 and got[0].alert == 303
    edges = physics.energy_edges(20, 150, 14)
    rows = [("a", lo, hi, round(1e6 * (lo**-2.5 - hi**-2.5))) for lo, hi in zip(edges, edges[1:], strict=False)]
    r = physics.power_law(spark.createDataFrame(rows, "series string, bin_lo double, bin_hi double, n long")).first()
    assert r["index"] == pytest.approx(3.5, abs=0.1) and r.error > 0
    rows = [("a", lo, hi, round(1e6 * math.exp(-(lo + hi) / 2 / 12) / ((lo + hi) / 2) * (hi - lo))) for lo, hi in zip(edges, edges[1:], strict=False)]
    assert physics.temperature(spark.createDataFrame(rows, "series string, bin_lo double, bin_hi double, n long")).first().kt == pytest.approx(12, abs=0.2)
    net = spark.createDataFrame([(1, k, 60.0) for k in range(22)], "event int, k long, net double")
    assert values(physics.adaptive_bins(net), "start", "stop", order="start") == [(0, 6), (6, 12), (12, 18)]


@pytest.mark.parametrize("digits,width", [(2, 1 << 14), (16, 4)])
def test_isotonic_against_pooling(spark, digits, width):
    """Rounded scores in one range, and unrounded ones in ranges of a few rows that are merged again and again."""
    rng = random.Random(6)
    data = [(round(p, digits), int(rng.random() < p)) for p in (rng.random() for _ in range(400))]
    knots = calibrate.isotonic(spark.createDataFrame(data, "p double, y int"), "p", "y", width=width)
    blocks = []
    for p in sorted({p for p, _ in data}):
        ys = [y for q, y in data if q == p]
        blocks.append([sum(ys), len(ys), p, p])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    for p, y in knots.collect():
        assert y == pytest.approx(next(s / n for s, n, lo, hi in blocks if lo <= p <= hi), abs=1e-6)


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(3000).select((F.col("id") % 60).alias("g"), (F.col("id") % 60 + F.col("id") % 7).cast("double").alias("v"))
    r = metrics.cluster_bootstrap(df, "v", "g").first()
    assert r.low < r.estimate < r.high and r.groups == 60 and 2 < r.high - r.low < 16
    assert r == metrics.cluster_bootstrap(df.repartition(7), "v", "g").first()


def _fits(columns, n, extname):
    """A file with one binary table, by the public standard."""
    import numpy as np

    def block(cards):
        text = "".join(f"{c:<80}" for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    rows = np.zeros(n, dtype=[(c, t, (m,) if m > 1 else ()) for c, _, t, m, _ in columns])
    for c, _, _, _, v in columns:
        rows[c] = v
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", f"NAXIS1  = {rows.dtype.itemsize:>20}", f"NAXIS2  = {n:>20}", "PCOUNT  =                    0", "GCOUNT  =                    1", f"TFIELDS = {len(columns):>20}"]
    for i, (c, form, _, m, _) in enumerate(columns, 1):
        cards += [f"TTYPE{i}  = '{c}'", f"TFORM{i}  = '{m}{form}'"]
    data = rows.tobytes()
    return block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]) + block([*cards, f"EXTNAME = '{extname}'"]) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_binary_tables(spark, tmp_path):
    import gzip
    import zipfile

    data = _fits([("TSTART", "D", ">f8", 1, [1.0, 2.0, float("nan")]), ("COUNTS", "E", ">f4", 4, [[1, 2, 3, 4]] * 3)], 3, "SPECTRUM")
    (tmp_path / "a.fits").write_bytes(data)
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(data))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/d.pi", data)
        z.writestr("x/readme.txt", "no table")
    (tmp_path / "broken.fits").write_bytes(b"nothing of the kind")
    got = fits.read(spark, str(tmp_path), "SPECTRUM", {"TSTART": "double", "COUNTS": "array<float>"}, r"\.pi$").collect()
    good = [r for r in got if r.error is None]
    assert len(good) == 9 and len([r for r in got if r.error]) == 1
    assert sorted({r.TSTART for r in good if r.TSTART}) == [1.0, 2.0] and good[0].COUNTS == [1.0, 2.0, 3.0, 4.0]


def test_store_takes_each_source_once(spark, tmp_path):
    src = spark.createDataFrame([("p1", 1), ("p2", 2)], "path string, size long").withColumn("key", tables.cache_key(["path", "size"], {"dt": 20}))
    none = spark.createDataFrame([], "key string, status string")
    assert tables.pending(src, none).count() == 2
    res = src.where("path = 'p1'").select("key", F.lit(1.0).alias("x"))
    tables.store(res, str(tmp_path / "store"))
    done = tables.status(spark.read.parquet(str(tmp_path / "store")), src)
    assert {r.status for r in done.collect()} == {"ok", "empty"}
    assert tables.pending(src, done).count() == 0
    assert src.select("key").first() != src.withColumn("key", tables.cache_key(["path", "size"], {"dt": 30})).select("key").first()


def test_future_rows_change_no_past_feature(spark):
    rng = random.Random(7)
    x = [rng.random() * 100 for _ in range(80)]
    a, b = series(spark, x), series(spark, x[:50] + [v + 1000 for v in x[50:]])
    for f in (lambda d: windows.causal_mean(d, 7, "f"), lambda d: windows.trailing_percentile(d, 9, 0.1, "f"), lambda d: windows.causal_diff(d, 3, name="f"), lambda d: windows.background_noise(d, 20, 600).withColumnRenamed("background", "f")):
        assert values(f(a).where("k < 50"), "f") == values(f(b).where("k < 50"), "f")


def test_alert_windows_stop_at_the_previous_peak(spark):
    ev = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 22, 40)], "series string, event long, start long, peak long")
    steps = spark.createDataFrame([("a", k) for k in range(-40, 60)], "series string, k long")
    assert values(alerts.windows_before(ev, steps), "start", "stop", order="event") == [(-20, 20), (21, 40)]


def test_last_event_wins_a_phase(spark):
    g = series(spark, [0.0] * 12)
    ev = spark.createDataFrame([("a", 1, 1, 4, 8), ("a", 2, 6, 8, 10)], "series string, event long, start long, peak long, stop long")
    assert values(labels.phases(g, ev, 1, 8), "phase") == [0, 1, 1, 2, 2, 2, 1, 2, 2, 2, 3, 0]


def test_manifest_and_inventory(spark):
    m = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("c", 3, 7), ("d", 4, 8)], "path string, size long, crc long")
    f = spark.createDataFrame([("a", 1, 5), ("b", 9, 6), ("c", 3, 1), ("e", 1, 1)], "path string, size long, crc long")
    assert {r.path: r.state for r in tables.verified(m, f).collect()} == {"a": "ok", "b": "size", "c": "content", "d": "missing", "e": "unknown"}
    src = spark.createDataFrame([("k1", "2024-01"), ("k2", "2024-01"), ("k3", "2024-02")], "key string, month string")
    got = tables.inventory(src, src.where("key = 'k1'"), F.col("month"))
    assert values(got, "sources", "done", "pending", order="month") == [(2, 1, 1), (1, 0, 1)]


def test_scoring_by_a_model_of_the_caller(spark):
    from gapline.operators import scoring

    df = series(spark, [1.0, None, 3.0, 4.0])
    w = scoring.with_window(df, 3, ["x"])
    assert values(w, "window") == [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 3.0], [0.0, 3.0, 4.0]]
    assert values(scoring.scored(w, lambda: lambda x: x.sum(axis=1)), "score") == [1.0, 1.0, 4.0, 7.0]


def test_forecaster(spark):
    from gapline.operators import activity

    rng = random.Random(8)
    rows = [("a", x, y, int(x + 0.1 * y > 0.5)) for x, y in ((rng.random(), rng.random()) for _ in range(300))]
    df = spark.createDataFrame(rows, "series string, x double, y double, label int")
    model = activity.forecaster(df, ["x", "y"], "label")
    drop = {r.feature: r["drop"] for r in activity.importance(df, model, ["x", "y"], "label").collect()}
    assert drop["x"] > 0.2 > drop["y"]
