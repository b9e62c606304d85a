"""The corpus pipeline: each stage is one operator of ``runwatch.llm`` over whole documents.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with the columns
of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runwatch.llm import langid, minhash, mixing, packing, shared, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose noisy-or of sentence scores reaches the limit go."""
    return toxicity.clean(docs, shared.labels(spark, sf_dir))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or without a language of posterior probability 1/2, go."""
    return langid.identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more stays.

    40 bands of 8 miss a pair exactly at 0.8 with probability 0.0006.
    """
    return minhash.deduplicated(docs, percent=80, bands=40)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: a document occurs as often as the mix takes it."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("minhash_near_dedup", without_copies),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]
#: learned scores and the tokenizer cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next stage."""
    docs = shared.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs)
    return docs
