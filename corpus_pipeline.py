"""The corpus pipeline: five stages over ``documents``, each writing Parquet that the next one reads.

Every stage works on all rows that its predecessor kept: it scores, groups or searches all of
them, and its decisions take effect. All but the last return the columns of ``documents``; the
last returns the encoded corpus's digests (doc_id, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from tidegauge.llm.queries import table, tokenizer_path
from tidegauge.llm.scratch import written
from tidegauge.session import reachable

#: The near-duplicate stage's shingles and similarity (op4's own query has 4 and 85).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.accepted(docs, table(reachable(spark), sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts one stays."""
    reachable(spark)
    return exact_dedup.deduplicated(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays: shingles of five words, a similarity of 0.8 or more."""
    reachable(spark)
    return ngram_join.one_of_each(docs, n_words=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(reachable(spark), sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    reachable(spark)
    return bpe.roundtrip(docs, tokenizer_path(), lean=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: A trained classifier and LSH are among the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each one returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
