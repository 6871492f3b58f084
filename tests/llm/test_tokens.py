import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gapline.llm import bpe, tokenfiles

from .data import documents, doubled, rows


def awkward(n=300):
    rng = random.Random(5)
    alphabet = "ab c'd.\n\t  é😀ñ1 2ſ 　·×÷œ\r\x1c-_"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(n)] + ["a" * 3000, "ab " * 5000, "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>\n<|endoftext|><|endof text|> c", "it's<|endoftext|>'s  <|endoftext|>  x"]


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, awkward())
    start, want = 0, []
    for r in sorted(rows(awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    written = tokenfiles.write_tokens(docs)
    got = sorted(tuple(r) for r in tokenfiles.digests(written).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert [(i, s, n, c) for s, i, n, c in got] == want
    assert tokenfiles.digests(tokenfiles.write_tokens(documents(spark, empty=True))).count() == 0


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_against_the_library(spark, tiktoken_ids):
    want = []
    for r in rows(awkward()):
        ids = tiktoken_ids(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = bpe.encoded(documents(spark, awkward())).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encoded(documents(spark, empty=True)).count() == 0


def test_decoding_gives_the_text_back(spark):
    docs = documents(spark, awkward(50)).where("doc_id >= 0").dropDuplicates(["doc_id"])
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def contracted(codec, words):
    flat, sizes = codec._contracted([w.encode() for w in words])
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def test_long_words(tiktoken_ids, monkeypatch):
    """Words of thousands of bytes, runs and periods among them, by both recursions."""
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    rng = random.Random(2)
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randrange(2, 40))) for _ in range(200)]
    words += ["a" * n for n in (3, 4, 5, 6, 7, 257, 5000)] + ["ab" * 700, "日本語" * 400, "".join(rng.choice("abcdefgh") for _ in range(2000))]
    want = [tiktoken_ids(w) for w in words]
    assert contracted(codec, words) == want
    monkeypatch.setattr(bpe, "LONG", 1)
    assert contracted(codec, words) == want
    more = ["".join(rng.choice(a) for _ in range(rng.randrange(2, 300))) for a in ("ab", "abc", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "日本語é") for _ in range(60)]
    more += [rng.choice("abcde") * rng.randrange(1, 20) + (rng.choice(["ab", "in", "ere"]) * rng.randrange(1, 60)) for _ in range(60)]
    assert contracted(codec, more) == [tiktoken_ids(w) for w in more]


def test_a_word_of_a_hundred_thousand_letters(tiktoken_ids):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    assert contracted(bpe.Codec(public_tokenizers.path(bpe.RANKS)), ["x", word, "y"])[1] == tiktoken_ids(word)


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_that_collide_modulo_powers_of_two(spark, tiktoken_ids, n):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = doubled(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encoded(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == tiktoken_ids(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for r in tokenfiles.write_tokens(docs).collect():
        assert r.ids == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]


def test_equal_hashes_give_no_other_pieces_ids(monkeypatch):
    """Were all hashes equal, the bytes would still tell pieces apart, within a block and across blocks."""
    from gapline.llm import pieces

    monkeypatch.setattr(pieces.Stretches, "of", lambda self, start, end: np.zeros(len(start), dtype=np.uint64))
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    for texts in (["the rest is", "is the rest of it"], ["of it", "the", "unwordedly"]):
        got = {i: b"".join(back) for i, _, back in codec.pieces.encode(texts, decode=True)}
        assert got == {i: t.encode() for i, t in enumerate(texts)}


def test_a_wrong_id_shows_in_the_decoded_bytes():
    """Decoding rests on the ids alone, for words that are tokens as a whole as well."""
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    right = next(codec.pieces.encode(["the rest is unwordedly"], decode=True))
    assert b"".join(right[2]) == b"the rest is unwordedly"
    codec = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    codec.ranks[b" rest"], codec.ranks[b" is"] = codec.ranks[b" is"], codec.ranks[b" rest"]
    wrong = next(codec.pieces.encode(["the rest is unwordedly"], decode=True))
    assert b"".join(wrong[2]) == b"the is rest unwordedly"
