"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import digests, write_tokens

    return digests(write_tokens(table(spark, sf_dir, "documents")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fuzzy import both_sides, passages

    return both_sides(passages(table(spark, sf_dir, "documents")))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identified, learned

    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs.where(~held_out())))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), with_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: 1024 * x of an embedding's component, as a whole number.
_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS s,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), src AS (
  SELECT s, sum(size)::BIGINT AS total, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY s LIKE 'n', s) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY s
), lam AS (  -- sources in the order in which they reach their cap
  SELECT s, total, w, 1.5 * sum(total) OVER () - coalesce(sum(2.0 * total) OVER (ORDER BY 2.0 * total / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0 * total / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM src
), level AS (SELECT max(remaining / weights) AS x FROM lam WHERE remaining / weights <= 2.0 * total / w),
tgt AS (
  SELECT s, total, least(2.0 * total, coalesce((SELECT x FROM level), 1e300) * w) AS target FROM src
), c AS (
  SELECT s, total, target, CASE WHEN total = 0 THEN 0 ELSE least(floor(target / total), 2) END AS copies FROM tgt
), hs AS (SELECT s, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY s, h),
run AS (
  SELECT s, h, n, sum(n) OVER (PARTITION BY s ORDER BY h) AS upto, target - copies * total AS rest FROM hs JOIN c USING (s)
), edge AS (SELECT s, coalesce(min(h) FILTER (upto > rest), max(h)) AS cut FROM run GROUP BY s),
e2 AS (SELECT run.s, cut, (n <= 2 * (rest - (upto - n))) AS inside FROM run JOIN edge ON run.s = edge.s AND run.h = edge.cut)
SELECT doc_id, size, c.total AS source_size, c.target AS target,
  (size * least(copies + CASE WHEN h < cut OR (h = cut AND inside) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM d JOIN c ON d.s = c.s LEFT JOIN e2 ON d.s = e2.s
"""


_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS u, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, u, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), x AS (SELECT u, hash(unnest(sh)) AS g FROM s),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.u < b.u GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.u = a JOIN s sb ON sb.u = b WHERE 100 * n >= 80 * (len(sa.sh) + len(sb.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT u AS a, u AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, s.doc_id = min(t.doc_id) AS kept
FROM s JOIN r ON r.a = s.u JOIN s t ON t.u = r.b GROUP BY s.u, s.doc_id, s.sh
"""


_AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied
  FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copied THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c)
    JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS me, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, me, coalesce(sum(n) FILTER (translate(fails, before || me, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, me) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, me) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = me), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, me) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, me) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, me
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, me))::BIGINT AS shapley
FROM r
"""


_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), o AS (SELECT u, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT u, lang, term FROM o) GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source AS one, y.source AS other, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) t ON t.lang = a.lang AND t.one = a.source AND t.other = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_neardup": _NEAR_SQL, "op2_exact_topk": _TOPK_SQL, "op4_source_mixing": _MIX_SQL, "op11_filter_audit": _AUDIT_SQL, "op13_source_divergence": _DIVERGENCE_SQL}
