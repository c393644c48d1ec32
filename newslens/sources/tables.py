"""Readers for the parquet tables and the article schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Raw headline rows as merged from the news API and the history file.
RAW_ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
])

ENTITY = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
RELATED = T.StructType([T.StructField("topic", T.StringType()), T.StructField("overlap", T.LongType())])

# The enriched article table the dashboard queries read.
ENRICHED_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("pol_leaning", T.StringType()),
    T.StructField("processed_content", T.StringType()),
    T.StructField("processed_content_truncated", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("topic_nr", T.IntegerType()),
    T.StructField("topic", T.StringType()),
    T.StructField("entities", T.ArrayType(ENTITY)),
    T.StructField("entity_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("related_topics", T.ArrayType(RELATED)),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_stored(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if nothing was ever stored there. Any other failure to read it is raised: taken
    for an empty history, it would be overwritten."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


SPREAD_CONF = "spark.newslens.spreadPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a text table over as many partitions as the caller asked for in
    ``spark.newslens.spreadPartitions``; unset (the default) leaves the table as scanned.

    Per-row text work is CPU-bound, and a table stored as one large row group is read by one
    task. Whoever runs such a table on many cores sets the number; nothing is decided by size.
    """
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n), key) if n else df
