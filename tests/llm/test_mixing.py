import random
import re
from collections import defaultdict

import pytest

from gapline.llm.mixing import mix, mixed_documents, targets

from .data import documents, rows


def plain_targets(totals, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Target of each source by filling up in rounds."""
    names = sorted(totals, key=lambda s: (s[0] == "n", s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(totals.values()), list(names)
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > most * totals[s]]
        if not full:
            out |= {s: each * weight[s] for s in free}
            break
        out |= {s: most * totals[s] for s in full}
        left, free = max(left - sum(out[s] for s in full), 0.0), [s for s in free if s not in out]
    return out


def test_targets(spark):
    rng = random.Random(2)
    cases = [{"va": 100, "vb": 100, "vc": 100}, {"n": 0, "va": 0}, {"n": 7, "v": 5}, {f"v{i}": rng.randrange(10 ** rng.randrange(1, 6)) for i in range(300)} | {"n": 40}]
    for totals in cases:
        got = {r["_s"]: r.target for r in targets(spark.createDataFrame(list(totals.items()), "_s string, total long")).collect()}
        assert got == {k: pytest.approx(v) for k, v in plain_targets(totals).items()}


def test_mix(spark):
    got = [r.asDict() for r in mix(documents(spark)).collect()]
    assert len(got) == len(rows())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows())
    by = defaultdict(list)
    for r in got:
        by[r["_s"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in by.values():
        assert abs(sum(r["taken"] for r in s) - s[0]["target"]) <= max(r["size"] for r in s) * 1.5  # a repeated row is taken alike
    again = mix(documents(spark).repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)


def test_documents_follow_the_mix(spark):
    want, got = defaultdict(int), defaultdict(int)
    for r in mix(documents(spark)).collect():
        want[str(r.doc_id)] += r.taken
    out = mixed_documents(documents(spark))
    assert out.columns == documents(spark).columns
    for r in out.collect():
        got[str(r.doc_id)] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert mixed_documents(documents(spark, empty=True)).count() == 0
