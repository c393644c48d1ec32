"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all of ``docs``, and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import decontam, packing, quality, secrets, simhash
from newslens.session import ensure_checkpoint_dir
from newslens.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates stays, that with the smallest id."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; ``n_chars`` is that of the masked text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_filter), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontaminate), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]

#: SQL cannot express the trained models, SimHash and the tokenizer; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What each but the last returns is kept as a Parquet table in the shared folder of
    ``spark.checkpoint.dir``, under a name of its own for every run."""
    docs, folder = table(spark, sf_dir, "documents"), os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
