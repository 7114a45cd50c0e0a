"""Corpus pipeline: quality rules, exact and near deduplication, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.

Order matters: rejected documents never become the kept copy of a group; exact copies are gone before
fingerprints are compared; shares of the mix are those of what remains; ids are made once, at the end.
Null, blank, repeated and extra-column cases are those of the operators' own docstrings; an empty
table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colloq.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from colloq.llm.queries import vocabulary_text
from colloq.session import checkpoint_dir, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.keep_by_policy(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents, as many times as their source's weight says."""
    return mixing.draw(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with ids, their number and the digests of ids and decoded text, without the text."""
    return bpe.encode(docs, vocabulary_text(), keep_text=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The drawn rows follow keyed 64-bit hashes and the fingerprints XXH64, which the SQL engine does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the stages' outputs in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
