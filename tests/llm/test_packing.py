import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from gapline.llm import packing

from .data import documents, rows
from .test_tokens import awkward


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def more():
    return [*awkward(120), "İ. İst-İ İ", "H\u0331a h\u0331a T\u0308 A\u030a A\u030aB I\u0307", "<|ENDOFTEXT|> <|EndOfText|>x", "THE The the tHe  THE\nThe", "É.̈ é.́ x", "Σ ΑΣ ΑΣ. ς", "don't.'s 12'll", "<|startoftext|>a<|startoftext|>", "word " * 9000]


@pytest.mark.parametrize("window,shard", [(2048, packing.SHARD), (64, 500), (2048, 1)])
def test_every_id_once_without_padding(spark, encode, window, shard):
    docs = rows(more())
    got = packing.packed(documents(spark, more()), window=window, shard_tokens=shard, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) >= 1 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0  # a power of two: no padding
    # all documents from their pieces, in any split: rows with equal ids are told apart by what fits together
    want = defaultdict(list)
    for r in docs:
        want[r[0]].append(encode(r[1]))
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, texts in want.items():
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
            assert [i for r in pieces for i in r.ids] == texts[0] and {r.doc_tokens for r in pieces} == {len(texts[0])}


def test_empty_table_and_columns(spark):
    assert packing.packed(documents(spark, empty=True)).count() == 0
    got = packing.packed(documents(spark))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_scores_are_those_of_bm25():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint16) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=40)
    idf = np.maximum(np.log((60 - df + 0.5) / (df + 0.5)), 0)
    mean = np.mean([len(p) for p in pieces])
    shard = packing.Shard(pieces, idf, mean)
    for seed in (0, 7, 31):
        unused = np.ones(60, dtype=bool)
        unused[[seed, 3, 4]] = False
        terms = shard.query(pieces[seed])
        score = {}
        for i, p in enumerate(pieces):
            tf = [int((p == t).sum()) for t in terms]
            s = sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(p) / mean)) for t, n in zip(terms, tf, strict=True))
            if s > 0 and unused[i]:
                score[i] = s
        got = np.concatenate(list(shard.neighbours(seed, unused, 5))).tolist()
        assert sorted(got) == sorted(score) and all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_windows_hold_neighbours():
    """Pieces of twelve topics, mixed: a window's pieces are of one topic but for what fills its end."""
    rng = random.Random(2)
    pieces = [np.array([t * 100 + rng.randrange(100) for _ in range(40)] + [1], dtype=np.uint16) for t in (rng.randrange(12) for _ in range(600))]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=1200)
    idf = np.where(df > 0, np.maximum(np.log((600 - df + 0.5) / (df + 0.5)), 0), 0)
    sequences = list(packing.fill(packing.Shard(pieces, idf, 41.0), 512))
    assert sum(n for s in sequences for *_, n in s) == 600 * 41 and all(sum(n for *_, n in s) == 512 for s in sequences[:-1])
    assert sorted(i for s in sequences for i, start, _ in s if start == 0) == list(range(600))
    same = [len({int(pieces[i][0]) // 100 for i, *_ in s}) == 1 for s in sequences]
    assert sum(same) > 0.7 * len(same)
