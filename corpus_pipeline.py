"""The training-corpus pipeline: language, exact and near copies, benchmark leaks, tokens.

Each stage works on all that the one before it kept. The filtering stages return
the rows that stay with the columns of ``documents``; the last one returns each
document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import runtime
from tessera.llm import common
from tessera.llm import op04_jaccard as jaccard
from tessera.llm import op05_decontaminate as benchmark
from tessera.llm import op06_bpe as bpe
from tessera.llm import op08_langid as language
from tessera.llm import op10_exact_dedup as exact


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those told ``und`` (no text, or no letter in it) go."""
    return language.understood(docs, language.fit(language.learn_from(docs)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    return exact.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity: the smallest id."""
    return jaccard.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return benchmark.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", runtime.shipped(known_language)),
    ("exact_dedup", runtime.shipped(exact_copies)),
    ("ngram_jaccard", runtime.shipped(near_copies)),
    ("decontamination", runtime.shipped(leaks)),
    ("byte_bpe", runtime.shipped(tokens)),
]

#: Language identification and tokens are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
