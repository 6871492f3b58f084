import random
import re
from collections import defaultdict
from itertools import permutations

from gapline.llm import audit

from .data import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def more():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcDe") for _ in range(4))
    texts = [" ".join(word() for _ in range(n)) + end for n in (199, 200, 201, 400) for end in ("", " #", " A" * 300, " tail" * 1000)]
    return texts + texts[:5] + ["x" * 300, "É" * 10 + "E"]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, None, 1), (20, 1, None), (21, 1, 1), (22, 0, 1), (1003, 1, 1), (1017, 1, 1), (77, 1, 1), (None, 1, 1), (None, None, None)]


def walked(docs, labels):
    """Every order walked document by document."""
    good, toxic = ({i for i, *x in labels if x[c] == 1 and i is not None} for c in (0, 1))
    least = {}
    for r in docs:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    out = defaultdict(int)
    for r in docs:
        t, part = r[1] or "", r[2] or ""
        ws = WORD.findall(t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and r[0] > least[t],
        }
        for p in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(p, 1):
                at = (part, "".join(p), step)
                hit = fails[f] and not gone
                out[at, "removed"] += hit
                out[at, "redundant"] += fails[f] and gone
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[at, "good_lost"] += hit and r[0] in good
                out[at, "toxic_lost"] += hit and r[0] in toxic
                out[part, f] += hit
                gone |= fails[f]
                out[at, "kept"] += not gone
    return out


def test_every_order_walked(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(documents(spark, more()), labels).collect()
    want = walked(rows(more()), LABELS)
    assert len(got) == 3 * 600 and len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    for r in got:
        at = (r.part, r.filter_order, r.step)
        assert [r[c] for c in audit.COUNTS] == [want[at, c] for c in audit.COUNTS[:-1]] + [want[r.part, r.filter_order[r.step - 1]]]


def test_words_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["aa", "bb", "ccc\n", "d\x0b"]) for _ in range(500))
    whole = audit._words(text.encode())
    monkeypatch.setattr(audit, "PART", 7)
    assert audit._words(text.encode()) == whole == (len(WORD.findall(text)), 4)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(documents(spark, empty=True), labels).count() == 0
    got = audit.filter_audit(documents(spark), labels)
    assert got.count() == 3 * 600 and got.where("good_lost + toxic_lost > 0").isEmpty()


def test_any_number_of_filters(spark):
    h = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 1), ("q", 2, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(h, "xy").collect()}
    assert got["p", "xy", 1] == (5, 5, 0, 3, 1, 2, 8) and got["p", "xy", 2] == (5, 0, 2, 0, 0, 0, 2)
    assert got["p", "yx", 1] == (8, 2, 0, 0, 0, 1, 2) and got["q", "xy", 1] == (7, 0, 0, 0, 0, 0, 0) and len(got) == 8
