import hashlib
import re

from gapline.llm.secrets import redacted, secret_scan

from .data import documents, rows

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def key(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_base_spans_against_brute_force(spark):
    got = secret_scan(documents(spark)).collect()
    want = sorted((str(r[0]), sum(k == 0 for _, k, _ in b), sum(k == 1 for _, k, _ in b), sum(k == 2 for _, k, _ in b), key(b)) for r in rows() for b in [base(r[1])])
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_weak_parts_need_company(spark):
    spans = {r.doc_id: r.spans for r in secret_scan(documents(spark)).collect()}
    assert [x.split(":")[0] for x in spans[10].split(",")] == ["account", "endpoint", "random"]
    assert spans[11] == "" and spans[12] == ""


def test_redaction_keeps_the_rest(spark):
    out = {r.doc_id: r for r in redacted(documents(spark)).collect()}
    assert out[8].text == 'x [SECRET]" y token=abc z [SECRET] q'
    assert out[6].text == rows()[6][1] and out[0].text is None and out[6].words == "w"
    assert redacted(documents(spark)).count() == len(rows())


def test_empty(spark):
    assert secret_scan(documents(spark, empty=True)).count() == 0
