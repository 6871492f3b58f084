"""Rolling-origin forecasts against a plain fit of each fold, and what a fold may not see."""

import random

import numpy as np
import pytest

from gapline.operators import rolling


def rows(n=230):
    rng = random.Random(21)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 2), rng.uniform(5, 6)
        y = 3 + 2 * a - b + rng.gauss(0, 0.5)
        out.append((f"s{i % 2}", i, 10 * i, None if rng.random() < 0.2 else a, None if i % 2 == 0 and i < 60 else b, None if rng.random() < 0.05 else y, f"day{i // 12}"))
    return out


SCHEMA = "series string, event long, t long, a double, b double, y double, day string"


def plain(data, folds, least):
    """Every fold fitted by itself: means of the training rows, indicators, least squares."""
    out = {}
    for s in ("s0", "s1"):
        mine = sorted((r for r in data if r[0] == s), key=lambda r: r[2])
        cut = np.array_split(np.arange(len(mine)), folds)
        for k in range(1, folds):
            train = [mine[i] for b in cut[:k] for i in b if mine[i][5] is not None]
            if len(train) < least:
                continue
            means = [np.mean([r[c] for r in train if r[c] is not None]) if any(r[c] is not None for r in train) else 0.0 for c in (3, 4)]
            row = lambda r, means=means: [1.0, *[m if r[c] is None else r[c] for c, m in zip((3, 4), means, strict=True)], *[float(r[c] is None) for c in (3, 4)]]
            fit = np.linalg.lstsq(np.array([row(r) for r in train]), np.array([r[5] for r in train]), rcond=None)[0]
            out |= {mine[i][1]: float(np.dot(row(mine[i]), fit)) for i in cut[k]}
    return out


def test_against_a_plain_fit_of_each_fold(spark):
    data = rows()
    df = rolling.blocks(spark.createDataFrame(data, SCHEMA), 5, "t")
    want = plain(data, 5, 40)
    got = {r.event: r.p for r in rolling.rolling_forecast(df, ["a", "b"], "y", 5, 40, name="p").collect()}
    assert len(got) == len(data) and {e for e, p in got.items() if p is not None} == set(want)
    assert all(got[e] == pytest.approx(p, abs=1e-6) for e, p in want.items())


def test_blocks_are_those_of_an_even_split(spark):
    for n in (3, 11, 230):
        got = rolling.blocks(spark.createDataFrame([("a", i, i, None, None, None, "d") for i in range(n)], SCHEMA), 5, "t")
        want = [k for k, b in enumerate(np.array_split(np.arange(n), 5)) for _ in b]
        assert [r.block for r in got.orderBy("t").collect()] == want


def test_later_rows_change_no_forecast(spark):
    """Labels and features from block 3 on are spoilt: the forecasts of blocks 1 to 3 stay, label or not."""
    data = rows()
    cut = {r[1] for s in ("s0", "s1") for b in np.array_split(np.array([r[1] for r in data if r[0] == s]), 5)[3:] for r in [(0, e) for e in b.tolist()]}
    spoilt = [(*r[:5], 1e6, r[6]) if r[1] in cut else r for r in data]
    run = lambda d: {r.event: (r.block, r.p) for r in rolling.rolling_forecast(rolling.blocks(spark.createDataFrame(d, SCHEMA), 5, "t"), ["a", "b"], "y", 5, 40, name="p").collect()}
    before, after = run(data), run(spoilt)
    early = [e for e, (b, _) in before.items() if b <= 3]
    assert len(early) > 150 and all(after[e] == (before[e][0], before[e][1] and pytest.approx(before[e][1], abs=1e-9)) for e in early)
    assert any(before[e][1] and after[e][1] != pytest.approx(before[e][1], rel=1e-3) for e in before)


def test_a_better_forecast_gains(spark):
    df = spark.createDataFrame([(r[6], r[5], (r[5] or 0) + 1.0, (r[5] or 0) + 0.5 * (-1) ** r[1]) for r in rows()], "day string, y double, far double, near double")
    r = rolling.paired_gain(df, "y", "far", "near", "day", 200).first()
    assert r.estimate == pytest.approx(0.5) and r.low == pytest.approx(0.5) and r.high == pytest.approx(0.5) and r.groups == 20
    e = {r.forecast: (r.n, r.mae) for r in rolling.error_summary(df, "y", ["far", "near"]).collect()}
    assert e["far"][1] == pytest.approx(1.0) and e["near"][1] == pytest.approx(0.5) and e["far"][0] == e["near"][0]
