"""A training corpus from ``documents``: language, near copies, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
that they are given. Stages cope with null, empty and very long texts and with repeated rows as their operators say;
an empty table passes through as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import jaccard, language, mixing, packing, secrets
from postmill.llm.shared import delete_at_exit, ensure_checkpoint_dir, ship

#: A text of which no language holds at least this share of the score is rejected.
MIN_LANGUAGE_SCORE = 0.35
#: SQL can't express the pipeline: it predicts languages, joins sets and tokenizes. tests/llm holds its brute-force version and compares run()'s rows with it.
ORACLE_SQL = None


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a known language. Null texts, texts without a letter and texts that no language explains best go."""
    ship(spark)
    model = language.learn(docs)
    # rows travel as one struct, so that no name of theirs meets one of ours
    found = language.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, carry=["row"])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8: the one with the least id."""
    ship(spark)
    return jaccard.drop_duplicates(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars counts the new text."""
    ship(spark)
    return secrets.redact_secrets(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate gives, in a new global order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths; a document that was drawn twice is packed twice."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("language ID", stage_language), ("n-gram Jaccard join", stage_near_copies), ("secret scans", stage_secrets), ("mixing sources", stage_mixing), ("packing", stage_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            if not k:
                delete_at_exit(spark, folder)
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
