import math
import random

from pyspark.sql import functions as F

from gapline.llm import topk


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(1)
    data = [(i, [rng.choice([-0.25, 0.0, 0.5, rng.random()]) for _ in range(6)], 0) for i in range(90)]
    data += [(5, None, 0), (10, [1.0, None], 0), (20, [float("nan")] * 6, 0), (30, [], 0), (7, data[7][1], 1), (40, [0.5] * 9, 1), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id, r.score) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, 5).collect())
    import numpy as np

    good = [(i, n, [math.floor(1024 * float(np.float32(x))) for x in v]) for n, (i, v, _) in enumerate(data) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, n, v in good:
        if i is not None and i % 10 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j) for j, m, w in good if m != n))[:5]
            want += [(i, r + 1, -1 if j == math.inf else j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, 5).count() == len(want)  # columns are pruned


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components_are_exact_or_an_error(spark):
    import pytest

    big = [float(2**40), float(2**41) + 1024, 3.0, -float(2**45)]
    data = [(i, [big[i % 4], float(i)]) for i in range(8)] + [(8, [2.0**-9, 0.0])]
    df = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in data}
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 8, 3).collect()]
    best = sorted((-sum(a * b for a, b in zip(whole[8], w)), i) for i, w in whole.items() if i != 8)[:3]
    assert sorted(got) == [(8, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="int|long|Overflow|large"):
        topk.top_k(df, F.col("vec_id") == 1, 3).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.quantised(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).count()
