"""The corpus pipeline: documents in, encoded training text out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm.common import checkpoint_folder, read
from tickspark.llm.exact_dedup import drop_copies
from tickspark.llm.minhash_dedup import drop_near_copies
from tickspark.llm.mixing import mixed_documents
from tickspark.llm.sentencepiece_fst import encode
from tickspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8), the smallest doc_id stays."""
    return drop_near_copies(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the source mix takes them, repeated by epoch."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, after a round trip through the decoder; workers give their memory back after each task."""
    return encode(docs, remember=300_000, keep=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: No stage but the second has a SQL twin, so the rows of the whole run have none; tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage is written and read again in the session's shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
