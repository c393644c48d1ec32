"""Article cleaning chain: dates, duplicates, encoding junk, language, boilerplate, outlets."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import dates
from newslens.functions import text as tx
from newslens.operators.dedupe import keep_first


def clean_content(df: DataFrame, col: str = "content",
                  snippets: Sequence[str] = fixed.NON_ARTICLE_SNIPPETS,
                  phrases: Sequence[str] = fixed.TRIM_AFTER_PHRASES,
                  words: Sequence[str] = fixed.GERMAN_MARKER_WORDS,
                  min_hits: int = fixed.GERMAN_MIN_WORDS) -> DataFrame:
    """Text steps in order: mojibake → NULL, non-German → NULL, snippets removed, cut at a
    trim phrase, URLs/copyright years/whitespace cleaned, blank → NULL.

    Each step is its own projection; Catalyst keeps the long snippet fold as one
    evaluated value instead of inlining it into every later reference.
    """
    out = df.withColumn(col, tx.null_if_mojibake(col))
    out = out.withColumn(col, tx.null_unless_german(col, words, min_hits))
    out = out.withColumn(col, tx.remove_snippets(col, snippets))
    out = out.withColumn(col, tx.trim_after(col, phrases))
    out = out.withColumn(col, tx.clean_text(col))
    return out.withColumn(col, tx.null_if_blank(col))


def drop_null_text(df: DataFrame, col: str = "content") -> DataFrame:
    """Drop rows whose ``col`` is NULL without a Filter on it.

    A filter on the cleaned text would be pushed below the cleaning projection
    and evaluate the whole chain twice (once in the filter, once in the
    projection); exploding the one-element array of non-NULL values drops the
    row in the same pass that computes the text.
    """
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(F.array_compact(F.array(F.col(col)))).alias(col)).select(*df.columns)


def clean_articles(raw: DataFrame, order: Sequence[str] = ("ingest_seq",),
                   allowed: Sequence[str] | None = fixed.ALLOWED_OUTLETS, **text_params) -> DataFrame:
    """Full cleaning of merged headline rows (title, source, url, publishedAt, description, content).

    ``order`` defines which row of a duplicated URL is first; its columns must exist, and rows that it leaves equal
    are ordered by all other columns, so the pick never depends on row order. Rows with a NULL in any column but
    the date are dropped; after the text steps rows without text are dropped too, the outlet is taken from the
    URL and only allowed outlets stay.
    """
    if missing := [c for c in order if c not in raw.columns]:
        raise ValueError(f"no such order columns: {missing}")
    df = raw.withColumnsRenamed({"publishedAt": "datetime"}) \
        .withColumn("datetime", dates.format_datetime("datetime"))
    rest = [c for c in df.columns if c != "url" and c not in order]
    df = keep_first(df, "url", [*order, *rest]).drop(*order)
    # Any NULL drops the row, except in the text (cleaned next) and the date: the
    # original turns a missing date into the text "nan" before this step, so
    # undated articles survive; here the date stays NULL and later rules
    # (digit test, month floor) decide.
    df = df.dropna(how="any", subset=[c for c in df.columns if c not in ("content", "datetime")])
    df = drop_null_text(clean_content(df, "content", **text_params), "content")
    df = df.withColumn("source", tx.outlet_from_url("url"))
    if allowed is not None:
        df = df.where(F.col("source").isin(*allowed))
    return df
