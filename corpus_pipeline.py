"""A training corpus from raw documents: language ID, near-dedup, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. Stages rerun to the same rows, so a lost executor
costs no more than its own partitions.

In every stage: texts are taken whole, however long; rows repeated in full are rows of their own until near-dedup keeps one;
null ids are ids like others; extra columns are carried along as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapline.llm import bpe, common, langid, mixing, neardup, secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters fit no known language go; lang becomes the prediction where it was null.

    Null and empty texts, and texts without a letter, fit none and go. Ties go to the first language in code-point order.
    """
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity of 0.8) stays.

    That of the least id; of equal ids the least text hash; of repeated rows the first in the order of all columns. Null and
    empty texts are groups of their own and stay.
    """
    return neardup.deduplicated(docs, words=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts in the text become a mask; every document stays, null texts as they are."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0, 1 or 2 times). A null source is one of its own; documents
    without words add nothing to the mix and follow their source's threshold like others."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them. Null and empty texts have no ids."""
    return bpe.encoded(docs, pieces=200_000, block=1 << 19)  # beside what earlier stages left in the workers


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Stages 1, 2 and 5 cannot be put in SQL; tests/llm/test_pipeline.py holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
