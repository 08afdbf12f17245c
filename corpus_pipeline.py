"""The corpus pipeline: five stages, each over all that its predecessor kept.

    language ID   documents without a language, or without a clear one, go
    quality rules rejected documents go, boilerplate lines are removed
    near-dedup    one document of each near-duplicate class stays
    secret scan   found secrets are replaced by a mark
    packing       documents become pieces of sequences of 1,024 tokens

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes every stage's result as
Parquet into the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm import langid, neardup, packing, quality, secrets
from careerloom.llm.queries import TOKENIZER
from careerloom.llm.shared import shared_table, table

#: A document whose best language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language."""
    model = langid.train(docs)
    judged = langid.identify(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass, without their boilerplate lines."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets replaced by a mark."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, **TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL expresses neither the classifiers nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of every document that all stages keep.

    Null text and text without a letter leave in the language stage; repeated rows are
    judged alike and near-dedup keeps one; an empty table gives an empty result; columns
    beyond those of ``documents`` pass through to the packing stage, which drops them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
