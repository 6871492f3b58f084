"""Alarm episodes of all thresholds in one pass against a walk for each threshold."""

import random

import pytest

from gapline.operators import alerts


def walked(steps, threshold, gap):
    out = []
    for k in sorted(k for k, v in steps.items() if v is not None and v >= threshold):
        if out and k - out[-1][1] <= gap:
            out[-1][1] = k
        else:
            out.append([k, k])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [1, 6])
def test_episodes_of_every_threshold(spark, gap):
    rng = random.Random(31)
    data, rows = {}, []
    for s in ("a", "b"):
        k, v, w = 0, 0.0, 0.0
        for _ in range(300):
            k += rng.choice([1, 1, 1, 2, 5, 9])
            v, w = max(0.0, v + rng.choice([-2, -1, 1, 2])), rng.choice([None, 0.0, 3.0, 9.0])
            rows.append((s, k, v, w))
            data.setdefault((s, "v"), {})[k] = v
            data.setdefault((s, "w"), {})[k] = w
    thresholds = [1.0, 3.0, 7.0, 100.0]
    df = spark.createDataFrame(rows, "series string, k long, v double, w double")
    got = sorted((r.series, r.arm, r.threshold, r.start, r.stop) for r in alerts.alarm_episodes(df, {"v": "v", "w": "w"}, thresholds, gap).collect())
    want = sorted((s, c, t, a, b) for (s, c), steps in data.items() for t in thresholds for a, b in walked(steps, t, gap))
    assert got == want and len({x[2] for x in want}) == 3


def test_curves_count_what_meets_no_event(spark):
    df = spark.createDataFrame([("a", k, 9.0 if k in (100, 400, 401, 800) else 2.0 if k == 600 else 0.0) for k in range(1440)], "series string, k long, x double")
    events = spark.createDataFrame([("a", 1, 405, 420, 410)], "series string, event long, start long, stop long, peak long")
    spans = spark.createDataFrame([("a", 1, 380, 410), ("a", 2, 590, 610), ("a", 3, 5000, 5010)], "series string, event long, start long, stop long")
    got = {r.threshold: (r.false, round(r.tpr, 6), r.false_per_day, r.chosen) for r in alerts.operating_points(df, "x", [1.0, 5.0, 50.0], events, spans, 2.0).collect()}
    assert got == {1.0: (3, round(2 / 3, 6), 3.0, False), 5.0: (2, round(1 / 3, 6), 2.0, True), 50.0: (0, 0.0, 0.0, False)}
