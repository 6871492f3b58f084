"""Numbers over spans of dense samples against plain numpy, and that no range frame is evaluated row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import activity, detect, physics, spans, temporal, windows


def _dense(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    t = rng.integers(1_000, 12_000, n)  # many samples share a second
    x = np.round(rng.exponential(30, n), 1)
    rows = [("a", int(k), None if i % 50 == 0 else float(v), i) for i, (k, v) in enumerate(zip(t, x, strict=True))]
    return spark.createDataFrame(rows, "series string, t long, x double, id long"), t, np.array([np.nan if r[2] is None else r[2] for r in rows])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_range_percentile_of_dense_samples(spark):
    df, t, x = _dense(spark)
    out = windows.trailing_range_percentile(df, 2000, 300, 0.3, 5)
    assert "Window" not in _plan(out)
    got = {r.id: r.percentile for r in out.collect()}
    assert len(got) == len(t)
    for i in range(0, len(t), 7):
        v = x[(t > t[i] - 2000) & (t <= t[i] - 300) & ~np.isnan(x)]
        assert got[i] == pytest.approx(np.quantile(v, 0.3)) if len(v) >= 5 else got[i] is None


@pytest.mark.parametrize("how", ["min", "max", "mean", "median"])
def test_rolling_over_dense_samples(spark, how):
    df, t, x = _dense(spark)
    out = windows.rolling(df, 700, 10, how, "v", 2.5)
    assert "Window" not in _plan(out)
    got = {r.id: r.v for r in out.collect()}
    f = {"min": np.min, "max": np.max, "mean": np.mean, "median": np.median}[how]
    some = set()
    for i in range(0, len(t), 7):
        v = x[(t > t[i] - 700) & (t <= t[i]) & ~np.isnan(x)]
        assert got[i] == pytest.approx(f(v)) if len(v) >= 2.5 * 70 else got[i] is None
        some.add(got[i] is None)
    assert some == {True, False}


def test_hours_of_dense_samples(spark):
    df, t, x = _dense(spark)
    out = activity.hourly(df, 1200, (1, 2))
    assert "Window" not in _plan(out)
    rows = out.collect()
    assert sorted(r.hour for r in rows) == [0, 1, 2, 3]
    there = ~np.isnan(x)
    for r in rows:
        last = t[there & (t // 3600 == r.hour)].max()
        assert r.now == x[there & (t == last)].max()
        v = x[there & (t > last - 7200) & (t <= last)]
        assert (r.min_2h, r.max_2h, r.mean_2h) == (v.min(), v.max(), pytest.approx(v.mean()))


def test_nan_is_the_greatest_and_empty_spans_are_null():
    x = np.array([3.0, np.nan, 1.0, 2.0])
    a, z = np.array([0, 2, 1, 1]), np.array([4, 4, 2, 1])
    assert spans.extremes(x, a, z, np.fmin)[[0, 1]].tolist() == [1.0, 1.0] and np.isnan(spans.extremes(x, a, z)[0])
    assert spans.Ranks(x).quantile(a, z, 0.5).tolist()[:2] == [2.5, 1.5]
    assert spans.extremes(x, a, z).mask.tolist() == spans.Ranks(x).quantile(a, z, 0.5).mask.tolist() == [False, False, False, True]
    assert spans.sums(np.ones(9), np.array([0, 3, 5]), np.array([9, 3, 8])).tolist() == [9, 0, 3]


def _around(spark):
    df, t, x = _dense(spark)
    events = df.where("id % 40 = 3").selectExpr("series", "id AS event", "t AS start", "t AS stop")
    return events, df, t, x, [i for i in range(len(t)) if i % 40 == 3]


def test_every_sample_counts_in_flare_records(spark):
    events, df, t, x, ids = _around(spark)
    got = {r.event: r for r in physics.flare_record(events, df, 1500, 700, 200).collect()}
    assert sorted(got) == ids
    for i in ids:
        since, there = t - t[i], ~np.isnan(x)
        whole, pre, known = (there & (since >= -1500) & (since <= z) for z in (700, -1, 200))
        r = got[i]
        assert (r.n, r.top, r.top_known) == (whole.sum(), x[whole].max(), x[known].max())
        assert r.top_at == since[whole & (x == r.top)].min()
        assert r.background == pytest.approx(np.median(x[pre])) if pre.any() else r.background is None


def test_every_sample_counts_in_backgrounds_as_by_pairs(spark):
    events, df, t, x, ids = _around(spark)
    got = {r.event: r for r in detect.backgrounds(events, df, 900).collect()}
    pairs = {r.event: r for r in detect.linear_background(temporal.slices(events, df, 900, 0, 4096)).collect()}
    assert sorted(got) == sorted(pairs) and max(r.n for r in got.values()) > 200
    for i, r in pairs.items():
        assert tuple(got[i])[-4:] == tuple(None if v is None else pytest.approx(v, abs=1e-9) for v in (r.n, r.slope, r.level, r.scatter))
    assert {bool(r.slope) for r in got.values()} == {True, False}


def test_every_sample_counts_in_onsets_and_hot_excess_as_by_pairs(spark):
    events, df, t, x, ids = _around(spark)
    near = temporal.slices(events, df, 0, 1700, 4096).groupBy("event", F.floor(F.col("since") / 60).alias("k")).agg(F.round(F.avg("x"), 9).alias("x"))
    want = detect.causal_onset(near, F.col("x") / 28, least=1.0)
    got = detect.causal_onsets(events, df, 60, 1700, lambda v: v / 28, least=1.0)
    assert sorted(map(tuple, got.select("event", "onset", "known").collect())) == sorted(map(tuple, want.select("event", "onset", "known").collect()))
    want = {r.event: r.significance for r in detect.hot_excess(temporal.slices(events, df, 1800, 120, 4096)).collect()}
    got = {r.event: r.significance for r in detect.hot_excesses(events, df).collect()}
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()} and len({v is None for v in got.values()}) == 2
