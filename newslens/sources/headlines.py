"""Headline API responses → flat article rows.

The HTTP call itself is not part of the library: responses are landed as JSON
documents (one per line, or one per row of a text column) and read here.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens import fixed

HEADLINE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("clean_url", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("published_date", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("language", T.StringType()),
])
RESPONSE = T.StructType([T.StructField("articles", T.ArrayType(HEADLINE))])


_CORRUPT = "_corrupt"
_WITH_CORRUPT = T.StructType([*RESPONSE.fields, T.StructField(_CORRUPT, T.StringType())])


def _parsed(df: DataFrame, body_col: str) -> DataFrame:
    parsed = F.from_json(F.col(body_col), _WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return df.withColumn("r", parsed)


def _flatten(resp: DataFrame, col: str = "r") -> DataFrame:
    a = resp.select(F.explode(F.col(f"{col}.articles")).alias("a"))
    return a.select(F.col("a.title").alias("title"), F.col("a.clean_url").alias("source"),
                    F.col("a.link").alias("url"), F.col("a.published_date").alias("publishedAt"),
                    F.col("a.summary").alias("description"), F.col("a.language").alias("language"))


def parse_responses(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Responses in a text column → one row per article; missing keys → NULL, responses without articles → no rows.
    Bodies that are no readable response are what `rejected_lines` returns."""
    return _flatten(_parsed(df, body_col))


def rejected_lines(df: DataFrame, body_col: str = "body") -> DataFrame:
    """(body, error) of the bodies that are not a readable response; NULL and blank bodies are not among them."""
    body = F.col(body_col)
    bad = body.isNotNull() & (F.trim(body) != "") & (F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull())
    return _parsed(df, body_col).where(bad).select(body.alias("body"), F.lit("unreadable response").alias("error"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed response files (JSON lines), like `parse_responses`."""
    return parse_responses(spark.read.text(path), "value")


def select_headlines(df: DataFrame, now, sources: Sequence[str] | None = None,
                     language: str | None = fixed.HEADLINE_LANGUAGE,
                     hours: int = fixed.HEADLINE_WINDOW_HOURS,
                     per_source: int = fixed.HEADLINES_PER_SOURCE) -> DataFrame:
    """The request parameters as filters: listed sources, language, published in the last
    ``hours`` before ``now``, at most ``per_source`` newest rows per source."""
    ts = F.coalesce(F.try_to_timestamp("publishedAt"),
                    F.try_to_timestamp("publishedAt", F.lit("yyyy-MM-dd HH:mm:ss")))
    out = df.withColumn("_ts", ts)
    if sources is not None:
        out = out.where(F.col("source").isin(*sources))
    if language is not None:
        out = out.where(F.col("language") == language)
    now_c = F.lit(now).cast("timestamp")
    out = out.where((F.col("_ts") > now_c - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("_ts") <= now_c))
    w = Window.partitionBy("source").orderBy(F.desc("_ts"), F.asc("url"))
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_source).drop("_rn", "_ts")
