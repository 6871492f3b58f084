import random
import re

import numpy as np
import pytest

from gapline.llm import neardup

from .data import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(data, k=4, percent=80):
    sets = [shingle_set(t, k) for _, t in data]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(data))


def chains(n=400):
    """Copies of copies with a few words changed each, so that similarities spread around the limit; tiny texts as well."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(300)}"
    out = [[word() for _ in range(rng.choice([3, 5, 9, 25, 60, 200]))] for _ in range(30)]
    while len(out) < n:
        t = list(rng.choice(out))
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(len(t))] = word()
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("members", [512, 8])
def test_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    extra = chains()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(documents(spark, extra)).collect())
    assert got == brute([(r[0], r[1]) for r in rows(extra)])


def test_real_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each_group_stays(spark):
    docs = documents(spark, chains(100))
    got = neardup.deduplicated(docs)
    data = [(r[0], r[1]) for r in rows(chains(100))]
    groups = {c for _, n, c in brute(data, 5) if n}
    out = got.collect()
    assert got.columns == docs.columns
    assert len([r for r in out if shingle_set(r.text, 5)]) == len(groups)
    assert len([r for r in out if not shingle_set(r.text, 5)]) == sum(not shingle_set(t, 5) for _, t in data)


def test_estimate_is_corrected():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        s = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(s[rng.permutation(len(s))[:2700]]), np.sort(s[rng.permutation(len(s))[:2700]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree = (neardup.registers(a) == neardup.registers(b)).mean()
        errors.append(neardup.estimate(agree, 2700.0, 2700.0) - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_empty(spark):
    assert neardup.near_duplicates(documents(spark, empty=True)).count() == 0
    assert neardup.deduplicated(documents(spark, empty=True)).count() == 0


def test_words_that_collide_modulo_powers_of_two(spark):
    """A word and its complement, alone and within like texts, are different words."""
    from .data import doubled

    pairs = [doubled(n) for n in (1024, 2048, 8192)]
    texts = [w for p in pairs for w in p] + [" ".join([w, "x"] * 3) for w in pairs[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (i, True) for i in range(len(texts))}
