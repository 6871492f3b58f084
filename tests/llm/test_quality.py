import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import quality
from gapline.llm.quality import base_counts, quality_rules

from .data import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    repeat = {i + j for i, w in enumerate(windows) if twice[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_counts_against_brute_force(spark):
    got = base_counts(documents(spark)).collect()
    want = sorted((str(r[0]), *counts(r[1])) for r in rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "in", "the"]) + str(rng.randrange(500)) for _ in range(rng.randrange(30, 400))) for _ in range(120)]
    junk = [" ".join(w + "#$%&|*" * 3 for w in t.split()) for t in clean[:6]]
    data = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules(data).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 126))


def test_outliers_of_small_groups_go(spark):
    """Sources and languages of a few documents are judged by the estimate of the language or of all documents."""
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "in", "the"]) + str(rng.randrange(500)) for _ in range(rng.randrange(60, 400)))
    junk = lambda: " ".join(w + "#$%&|*" * 3 for w in prose().split())
    small = [("en", "t"), ("en", None), ("xx", "t"), (None, None)]
    data = [(i, prose(), "en", "s") for i in range(120)] + [(200 + i, prose(), *g) for i, g in enumerate(small)] + [(300 + i, junk(), *g) for i, g in enumerate(small)]
    got = quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(data) and {r.doc_id for r in got if not r.kept} == {300, 301, 302, 303}


def test_moderately_bad_documents_go(spark):
    """10 to 20% symbols, or half of the lines repeated, beside clean documents with a few of both."""
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "in", "the"]) + str(rng.randrange(500)) for _ in range(8))
    prose = lambda: [line() for _ in range(rng.randrange(20, 60))]
    symbols = lambda t, share: re.sub(r"\S+", lambda m: m[0] + "#" * (int(share / (1 - share) * len(m[0]) + rng.random())), t)
    clean = ["\n".join(prose()) + (" & #" if i % 4 == 0 else "") for i in range(120)]
    bad = [symbols("\n".join(prose()), share) for share in (0.1, 0.15, 0.2)]
    bad += ["\n".join([x for y in prose() for x in (y + " " + line(), line(), "end", "end")]) for _ in range(2)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + bad)], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not got[i].kept for i in range(120)) <= 1
    assert not any(got[i].base_failed or got[i].kept for i in range(120, 125))


def plain_mcd(x, starts=60, support=0.75):
    """The least determinant of scatter plus floors by exact concentration steps from many random starts."""
    rng = np.random.default_rng(1)
    h, floors = int(np.ceil(support * len(x))), np.diag((np.array(quality.FLOORS) * quality.SCALE) ** 2)
    best = (np.inf, None, None)
    for k in range(starts):
        sub = x[rng.choice(len(x), 5 if k else len(x), replace=False)]
        before = np.inf
        while True:
            m, c = sub.mean(axis=0), np.cov(sub.T, bias=True) + floors
            det = np.linalg.slogdet(c)[1]
            if len(sub) == h and det > before - 1e-9:
                break
            before = det if len(sub) == h else np.inf
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            sub = x[np.argsort(d2, kind="stable")[:h]]
        if det < best[0]:
            best = (det, m, c)
    return best


def test_estimates_against_a_plain_version(spark):
    """Determinants no larger than exact steps from 60 starts reach, and distances that agree, with a third of bad vectors aside."""
    rng = np.random.default_rng(4)
    groups = {}
    for g in range(4):
        n = 400
        x = rng.multivariate_normal([1700, 300, 200, 100], np.diag([150, 400, 500, 300]) @ (np.eye(4) * (1 - g / 5) + g / 5) @ np.diag([150, 400, 500, 300]), n)
        x[: 30 * g] = rng.multivariate_normal([2600, 3500, 3000, 100 + 900 * g], np.eye(4) * 9000, 30 * g)
        groups[f"g{g}"] = np.maximum(np.round(x), 0).astype(int)
    rows = [(g, *map(int, v), 1) for g, x in groups.items() for v in x]
    fit = spark.createDataFrame(rows, "_group string, x0 long, x1 long, x2 long, x3 long, _w long")
    got = {r["_group"]: r.asDict() for r in quality.estimates(fit).collect()}
    for g, x in groups.items():
        det, m, c = plain_mcd(x.astype(float))
        e = got[g]
        assert e["_det"] <= det + 0.02, (g, e["_det"], det)
        p = np.array([[e[f"p{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        d = x - np.array([e[f"m{i}"] for i in range(4)])
        mine, plain = np.einsum("ij,jk,ik->i", d, p, d), np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        assert np.corrcoef(mine, plain)[0, 1] > 0.99 and np.median(np.abs(mine / plain - 1)) < 0.1


def test_verdict_against_a_plain_version(spark):
    """distance2 and kept of whole documents, one group, against exact steps and the same scaling."""
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gammas", "delta", "of", "in", "the"]) + str(rng.randrange(500))
    texts = ["\n".join(" ".join(word() + ("#" if rng.random() < i % 7 / 60 else "") for _ in range(8)) for _ in range(rng.randrange(5, 40))) for i in range(150)]
    texts += [t + "\n" + "\n".join([t.split("\n")[0]] * (3 + i % 9)) for i, t in enumerate(texts[:20])] + [t.replace(" ", " $%&") for t in texts[20:35]]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    out = quality_rules(docs)
    vectors = {r.doc_id: r for r in base_counts(docs).select("doc_id", "base_failed", F.array(*quality.features()).alias("x")).collect()}
    x = np.array([r.x for r in vectors.values() if not r.base_failed], dtype=float)
    _, m, c = plain_mcd(x)
    d2 = np.sort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))
    scale = quality.CHI2_SUPPORT / max(d2[int(np.ceil(0.75 * len(x))) - 1], quality.CHI2_SUPPORT / quality.MOST_SCALE)
    n = 0
    for r in out.collect():
        v = np.array(vectors[r.doc_id].x) - m
        want = v @ np.linalg.inv(c) @ v * scale
        assert abs(r.distance2 - want) <= 0.1 * want + 0.3, (r.doc_id, r.distance2, want)
        if abs(want - quality.CUTOFF) > 2:
            assert r.kept == (want <= quality.CUTOFF and not r.base_failed)
            n += 1
    assert n > 150


def test_awkward_rows(spark):
    out = quality_rules(documents(spark)).collect()
    assert len(out) == len(rows()) and all(r.kept is not None and not (r.kept and r.base_failed) for r in out)
    assert quality_rules(documents(spark, empty=True)).count() == 0
