"""A training corpus from raw documents, in five stages.

Each stage works on all that its predecessor kept; ``run`` writes what a stage
returns as Parquet to the folder in ``spark.checkpoint.dir`` and reads it back for the next. All stages but the last
return the columns of ``documents``. NULL texts count as empty; other columns pass
through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm import bpe, decontaminate, jaccard, quality, secrets
from rewardloom.llm.common import table
from rewardloom.scratch import materialize

#: Near copies: words of a shingle and similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with cutoffs fitted to this input."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts."""
    return jaccard.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and their new lengths."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of these and of the text decoded from them."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ids="ids", decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", *bpe.digests(encoded))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("tokens", tokens),
]

#: The components of near copies, windows of similar shingles and byte-pair merges are out of SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
