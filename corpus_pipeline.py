"""Corpus pipeline: from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouploom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from grouploom.llm.common import saved, table

#: Tokens of each language after mixing.
TARGETS = {"en": 0.58, "de": 0.155, "fr": 0.155, "es": 0.11}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects go."""
    labels = table(spark, sf_dir, "labels")
    chosen = quality.training_documents(docs, labels)
    return quality.accepted(docs, quality.fit(quality.features(chosen), labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays (five words, 0.8)."""
    return near_dedup.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards target shares of languages; each stays at least once."""
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"), with_quality=False)
    return mixing.repeated_to_targets(docs, labelled, TARGETS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the digest of what they decode to."""
    coded = bpe.encode(docs, bpe.default_tokenizer(), keep=("doc_id", "lang", "source"))
    return coded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: The quality model, the mixing fit and the encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
