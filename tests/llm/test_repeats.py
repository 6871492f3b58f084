import hashlib
import random
from collections import Counter

import numpy as np

from gapline.llm import repeats

from .data import documents, doubled, rows


def brute(data, length=400):
    data = [(d, (t or "").encode()) for d, t in data]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def passages():
    """Passages around 400 bytes in different surroundings, overlapping ones, periodic texts and texts in text."""
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefg éß\n") for _ in range(n))
    shared = [prose(n) for n in (300, 360, 398, 400, 405, 700, 1500, 4000)]
    out = []
    for _ in range(120):
        p = rng.choice(shared)
        a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
        cut = rng.choice([p, p[a:], p[:b], p[a:b], p[:a] + "#" + p[a:]])
        out.append(prose(rng.randrange(300)) + cut + prose(rng.randrange(300)) + (rng.choice(shared) if rng.random() < 0.3 else ""))
    return out + ["a" * 1000, "ab" * 900, "a" * 399, "a" * 400, prose(500) * 3, "xyz" * 500, *doubled(1024), *doubled(4096, "c", "d")]


def test_cells_of_parts_cover_every_start(monkeypatch):
    buf = np.frombuffer("".join(passages()).encode(), dtype=np.uint8)[:9000]
    for part in (1 << 22, 700):
        monkeypatch.setattr(repeats, "PART", part)
        p, low, high, _ = repeats.cells(buf)
        starts = np.concatenate([np.arange(a - z, a - y + 1) for a, y, z in zip(p, low, high, strict=True)])
        assert sorted(starts) == list(range(len(buf) - 399)) and (low >= 0).all() and (high <= 300).all()


def test_against_brute_force(spark):
    extra = passages()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(documents(spark, extra)).collect())
    want = brute([(r[0], r[1]) for r in rows(extra)])
    assert [g for g, w in zip(got, want) if g != w] == []
    assert got == want and sum(w[2] > 0 for w in want) > 60


def test_real_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert repeats.without_repeats(documents(spark, empty=True)).count() == 0


def test_documents_against_brute_force(spark):
    """The whole smallest table against every window of 400 bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = repeats.without_repeats(docs).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(x[2] > 0 for x in want) > 10


def test_planted_passages_are_in_the_spans_and_gone_from_what_is_left(spark):
    """Of passages of over 50 words those of 400 bytes go, with their spans; shorter ones and clean documents stay whole."""
    rng = random.Random(11)
    prose = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(size)) for _ in range(n))
    long, short = prose(60, 8), prose(55, 5)
    texts = {i: prose(rng.randrange(20, 200), 6) for i in range(40)}
    texts |= {i: f"{texts[i]} {(long, short)[i % 2]} {prose(30, 7)}" for i in range(0, 40, 5)}
    docs = spark.createDataFrame([*texts.items(), (40, None), (41, "")], "doc_id long, text string")
    left = {r.doc_id: r for r in repeats.removals(docs).collect()}
    said = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert sorted(left) == sorted(said) == list(range(42))
    for i, r in left.items():
        buf = (texts.get(i) or "").encode()
        assert bytes(r.kept) == b"".join(buf[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(buf)]))
        assert all(s.end - s.start >= 400 for s in r.spans) and r.n_bytes == len(buf)
        planted = i % 10 == 0 and i < 40
        assert said[i].repeated == planted == bool(r.spans) and said[i].spans == ",".join(f"{s.start}:{s.end}" for s in r.spans)
        if planted:
            at = buf.index(long.encode())
            assert any(s.start <= at and s.end >= at + len(long.encode()) for s in r.spans) and long.encode() not in bytes(r.kept)
        elif i % 5 == 0 and i < 40:
            assert short.encode() in bytes(r.kept)
        assert hashlib.sha256(r.kept).hexdigest() == said[i].kept_sha256
