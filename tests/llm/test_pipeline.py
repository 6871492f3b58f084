"""The whole pipeline against a plain version of every stage."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from gapline.llm import secrets
from gapline.llm.langid import LEAST_SCORE, TOP

from .test_mixing import plain_targets as targets
from .data import documents, rows
from .test_langid import grams, profile
from .test_neardup import brute, chains, shingle_set
from .test_secrets import ASSIGN

pipeline = pytest.importorskip("corpus_pipeline")


def known_language(data):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    total = {}
    for i, text, lang, *_ in data:
        if lang is not None and text is not None and not out(i):
            total.setdefault(lang, Counter()).update(grams(text))
    model = {lang: profile(c) for lang, c in total.items()}
    kept = []
    for i, text, lang, *rest in data:
        own = profile(grams(text))
        if own:
            away = {x: sum(abs(r - p[g]) if g in p else TOP for g, r in own.items()) for x, p in sorted(model.items())}
            best = min(away, key=away.get)
            if 1 - away[best] / (TOP * len(own)) >= LEAST_SCORE:
                kept.append((i, text, lang or best, *rest))
    return kept


def one_of_each(data):
    seen, out = set(), []
    ids = brute([(n, r[1]) for n, r in enumerate(data)], 5)  # by place, as ids repeat
    group = {int(n): c for n, _, c in ids}
    order = sorted(range(len(data)), key=lambda n: (data[n][0] is None, data[n][0] or 0, n))
    for n in order:
        if not shingle_set(data[n][1], 5) or group[n] not in seen:
            seen.add(group[n])
            out.append(data[n])
    return out


def masked(text):
    found = [(m.start(), m.end(), "s") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "i") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "s") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    strong = list(found)
    weak = [(m.start(), m.end(), r) for p, r in ((secrets.ACCOUNT, "i"), (secrets.RANDOM, "s"), (secrets.ENDPOINT, "e")) for m in re.finditer(p, text)]
    for s, e, r in weak:
        near = {x for t, _, x in found + weak if abs(t - s) <= secrets.SCOPE}
        inside = any(t <= s and u >= e for t, u, _ in found)
        if not inside and ("s" in near if r in "ie" else near & {"i", "e"}):
            strong.append((s, e, r))
    out, at, runs = "", 0, []
    for s, e, _ in sorted(strong):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out, at = out + text[at:s] + "[SECRET]", e
    return out + text[at:]


def mixed_in(data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda r: "n" if r[3] is None else "v" + r[3]
    by = defaultdict(list)
    for r in data:
        by[key(r)].append(r)
    goal = targets({s: sum(size(r[1]) for r in x) for s, x in by.items()})
    out = []
    for s, x in by.items():
        total = sum(size(r[1]) for r in x)
        copies = min(int(goal[s] // total), 2) if total else 0
        left, run = goal[s] - copies * total, 0
        h = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:15], 16)
        for r in sorted(x, key=h):
            n = size(r[1])
            more = run + n <= left or (run <= left and n <= 2 * (left - run))
            run += n
            out += [r] * min(2, copies + more)
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    extra = [t for t in chains(60)] + ["secret = s3cr3tValue99 and more words in the text " * 3]
    documents(spark, extra).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed_in([(r[0], masked(r[1]), *r[2:]) for r in one_of_each(known_language(rows(extra)))]):
        ids = coder.encode_ordinary(r[1])
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    assert got == sorted(want) and len(got) > 20


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty(spark, tmp_path):
    documents(spark, empty=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
