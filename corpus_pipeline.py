"""Corpus pipeline: quality rules, near-dedup, decontamination, secrets and encoding, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads again as the
next one's docs. All but the last return the columns of docs as they are, further ones too. They bound the session's Arrow
batches, as whole texts go through them.

Defined results: a document with null, empty or blank text fails the quality rules; null doc_ids are carried along; an
empty table gives empty tables; repeated rows leave one row after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docugrain.llm import bpe, decontaminate, near_dups, quality_rules, secrets
from docugrain.llm.common import cut, free, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go."""
    small_batches(spark)
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each component of near-duplicates (similarity 0.8 on five-word shingles) the least doc_id stays."""
    small_batches(spark)
    return near_dups.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a window that matches a benchmark item (similarity 0.8) go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets become [SECRET]; all documents stay, and n_chars follows the new text."""
    small_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens and ids of what is left."""
    small_batches(spark)
    return bpe.encode_ids(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("encoding", encoding)]

#: zstandard ratios and BPE have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Stage results are written tables, so that no stage is computed twice; each goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        free(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
