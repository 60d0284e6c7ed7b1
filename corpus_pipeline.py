"""From raw documents to a tokenised training mix, five stages, each a Spark job of its own.

Every stage takes what its predecessor kept, is written as Parquet in the shared folder
and read again, so a lost executor costs a task and a failed stage can be run again.
All but the last return the columns of ``documents``; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passforge.llm import bpe, exact, mixing, ngramjoin, quality
from passforge.llm.common import stored, table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labels at hand, rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle Jaccard, the document with the least doc_id stays."""
    return ngramjoin.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token_ids (little-endian u32), n_tokens and the decoded text."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier is learned, the Jaccard groups are transitive: no SQL. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
