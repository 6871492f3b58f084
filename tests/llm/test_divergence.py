import random
import re
from collections import Counter, defaultdict

import pytest

from gapline.llm import divergence

from .data import documents, rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top=50):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in docs:
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        found = TERM.findall((r[1] or "").translate(LOWER))
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        share = {}
        for s in [*sources, None]:
            c = count[lang, s] if s is not None else sum((count[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}
        for a in sources:
            pairs = [(sum(abs(share[a][t] - share[b][t]) for t in kept), b) for b in sources if b != a]
            terms = [(share[a][t] - share[None][t], t) for t in kept if count[lang, a][t] > 0 and share[a][t] > share[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, a, part, i, value, k) for k, (value, i) in enumerate(ordered, 1) if part == "pair" or k <= top}
    return out


def texts():
    rng = random.Random(9)
    words = ["an", "The", "ou", "né", "İst", "ſt", "日本", "x1y", "a-b", "Zz", "\x00q", "~w"]
    return [" ".join(rng.choice(words[: rng.randrange(1, 12)]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]


def test_against_plain_counts(spark):
    for least in (1, 3):
        got = [tuple(r) for r in divergence.divergence(documents(spark, texts()), least).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows(texts()), least)


def many(n=40):
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "e" + str(i % 7)]) for _ in range(rng.randrange(0, 9))), ("en", "de")[i % 2], f"s{rng.randrange(n)}") for i in range(300)]


@pytest.mark.parametrize("size", [{}, {"pairs": 1}, {"pairs": 400}, {"block": 5, "most": 10}])
def test_many_sources_small_blocks_and_batches(spark, size):
    """Whatever is held at once, the sums are the same; short batches cut runs in the middle."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        docs = spark.createDataFrame(many(), "doc_id long, text string, lang string, source string")
        got = [tuple(r) for r in divergence.divergence(docs, 3, 4, **size).select("lang", "source", "part", "item", "value", "rank").collect()]
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(set(got)) and set(got) == plain(many(), 3, 4)


def test_empty_and_without_terms(spark):
    assert divergence.divergence(documents(spark, empty=True)).count() == 0
    got = divergence.divergence(documents(spark), 10**6).collect()  # no kept term: pairs alone, all of value 0
    assert got and {(r.part, r.value) for r in got} == {("pair", 0)}
