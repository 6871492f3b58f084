import zlib
from collections import Counter

import pytest

from gapline.llm.langid import LEAST_SCORE, TOP, accepted, held_out, identified, learned

from .data import documents, rows


def grams(text):
    word, out = "", Counter()
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f"\x01{word}\x01"
            out.update(word)
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
            word = ""
    # a word's end and the next one's start share their mark
    return out


def profile(counts):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:TOP])}


def test_against_brute_force(spark):
    docs = documents(spark)
    got, blocks = (sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in identified(docs, learned(docs.where(~held_out()), labels=n)).collect()) for n in (2000, 1))
    assert got == blocks
    total = {}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    for i, text, lang, *_ in rows():
        if lang is not None and not out(i):
            total.setdefault(lang, Counter()).update(grams(text))
    model = {lang: profile(c) for lang, c in total.items()}
    want = []
    for i, text, *_ in rows():
        own = profile(grams(text))
        away = {lang: sum(abs(r - p[g]) if g in p else TOP for g, r in own.items()) for lang, p in sorted(model.items())}
        best = min(away, key=away.get) if own else "und"
        want.append((str(i), out(i), best, round(1 - away[best] / (TOP * len(own)), 9) if own else 0.0))
    assert got == sorted(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identified(docs, learned(docs.where(~held_out()))).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert right / n > 0.97


def test_accepted(spark):
    out = accepted(documents(spark)).collect()
    assert {r.doc_id for r in out}.isdisjoint({0, 1, 2, 17}) and accepted(documents(spark)).columns == documents(spark).columns
    assert {5, 6, 7, 20} <= {r.doc_id for r in out} and all(r.lang for r in out) and LEAST_SCORE > 0
    empty = documents(spark, empty=True)
    assert accepted(empty).count() == 0 and identified(empty, learned(empty)).count() == 0


@pytest.mark.parametrize("text", [None, "", "12 34 !?"])
def test_und(spark, text):
    docs = spark.createDataFrame([(1, text, "en"), (3, "some words here", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in identified(docs, learned(docs)).collect()}[1] == ("und", 0.0)
