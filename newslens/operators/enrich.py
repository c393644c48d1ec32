"""Per-article enrichment: political leaning, tokens, sentiment, pluggable batch scorers."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens import fixed
from newslens.functions import text as tx
from newslens.functions.scores import spark_stopwords
from newslens.operators.joins import lookup_join


def leaning_dim(spark: SparkSession, mapping: dict = fixed.OUTLET_LEANING) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "source string, pol_leaning string")


def assign_leaning(df: DataFrame, dim: DataFrame | None = None, source_col: str = "source") -> DataFrame:
    """Left lookup of the outlet's leaning; outlets missing from the table get NULL."""
    known = len(fixed.OUTLET_LEANING) if dim is None else None  # the fixed table's size is known
    dim = dim if dim is not None else leaning_dim(df.sparkSession)
    dim = dim.withColumnRenamed("source", source_col)
    base = df.drop("pol_leaning") if "pol_leaning" in df.columns else df
    return lookup_join(base, dim, source_col, "left", known_rows=known)


def with_tokens(df: DataFrame, text_col: str = "content", stop: Sequence[str] | None = None,
                max_tokens: int = fixed.MODEL_MAX_TOKENS, text_columns: bool = True) -> DataFrame:
    """Adds ``tokens`` (stop words removed) and, unless ``text_columns`` is false,
    ``processed_content`` and ``processed_content_truncated`` (first ``max_tokens`` tokens)."""
    stop = spark_stopwords("german") if stop is None else stop
    out = df.withColumn("tokens", tx.drop_stopwords(tx.tokens(text_col), stop))
    return with_processed_text(out, max_tokens) if text_columns else out


def with_processed_text(df: DataFrame, max_tokens: int = fixed.MODEL_MAX_TOKENS,
                        tokens_col: str = "tokens") -> DataFrame:
    """``processed_content`` (tokens joined by a space) and its first ``max_tokens`` tokens.

    Both are cheap functions of the token array, so a pipeline that materialises
    its rows can derive them afterwards instead of storing the text twice more.
    """
    return df.withColumn("processed_content", tx.join_tokens(tokens_col)) \
        .withColumn("processed_content_truncated", tx.join_tokens(tx.truncate_tokens(tokens_col, max_tokens)))


# Default sentiment lexicon (our own, small): lower-case German word forms with
# weight +1 or -1. Replace it with a domain lexicon or a model through
# ``score_in_batches``.
POSITIVE_WORDS = (
    "gut", "gute", "guten", "besser", "beste", "besten", "erfolg", "erfolgreich", "gewinn", "gewinnt",
    "freude", "froh", "glück", "hoffnung", "sieg", "stark", "stärker", "wachstum", "frieden", "einigung",
    "lob", "gelungen", "positiv", "sicher", "rettung",
)
NEGATIVE_WORDS = (
    "schlecht", "schlechter", "krise", "krieg", "angriff", "tot", "tote", "toten", "verlust", "verluste",
    "angst", "gefahr", "streik", "skandal", "kritik", "scheitern", "gescheitert", "unfall", "opfer",
    "gewalt", "terror", "inflation", "niederlage", "negativ", "katastrophe",
)


def lexicon_score(tokens_col: str = "tokens", positive: Sequence[str] = POSITIVE_WORDS,
                  negative: Sequence[str] = NEGATIVE_WORDS):
    """Sum of word weights over all tokens of the text, evaluated inside the row (no shuffle)."""
    # isin over literal lists becomes a hash-set lookup per token.
    return F.aggregate(F.col(tokens_col), F.lit(0),
                       lambda acc, w: acc + F.when(w.isin(*positive), 1).when(w.isin(*negative), -1).otherwise(0))


def label_from_score(score) -> F.Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


def lexicon_sentiment(df: DataFrame, tokens_col: str = "tokens", **lexicon) -> DataFrame:
    """Sentiment label from the lexicon score of the whole text."""
    return df.withColumn("sentiment_score", lexicon_score(tokens_col, **lexicon)) \
        .withColumn("sentiment", label_from_score("sentiment_score"))


def score_in_batches(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text_col: str,
                     out_col: str = "sentiment", out_type: str = "string",
                     batch_rows: int = fixed.SENTIMENT_BATCH * 100, error_col: str | None = None) -> DataFrame:
    """Run a user scoring function (e.g. a pre-trained model) over Arrow batches of texts.

    ``fn`` gets a pandas Series of texts and returns one value per text. It runs
    in every task on the task's own rows (``mapInPandas``), so the model is
    loaded per Python worker and the rows never leave their partition. The key
    columns travel with the text, so row order does not matter.

    With ``error_col`` a failing text does not end the job: a batch that ``fn`` raises on is tried again text by
    text, and a text that still fails has a NULL result and the error's message in that column (else NULL).
    """
    extra = [T.StructField(out_col, T._parse_datatype_string(out_type))]
    extra += [T.StructField(error_col, T.StringType())] if error_col else []
    schema = T.StructType(df.schema.fields + extra)

    def scored(texts: pd.Series) -> tuple[list, list]:
        try:
            return list(fn(texts)), [None] * len(texts)
        except Exception as e:  # noqa: BLE001  (any failure of the user's function becomes the row's error)
            if error_col is None:
                raise
            if len(texts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        parts = [scored(texts.iloc[i:i + 1]) for i in range(len(texts))]
        return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows].copy()
                part[out_col], errors = scored(part[text_col])
                if error_col:
                    part[error_col] = errors
                yield part

    return df.mapInPandas(run, schema)


_SCORERS: dict[str, tuple[Callable, str]] = {}


def register_scorer(name: str, fn: Callable[[pd.Series], pd.Series], out_type: str = "string") -> None:
    """Make a batch scoring function available by name (see ``apply_scorer``)."""
    _SCORERS[name] = (fn, out_type)


def apply_scorer(df: DataFrame, name: str, text_col: str, out_col: str | None = None,
                 error_col: str | None = None) -> DataFrame:
    fn, out_type = _SCORERS[name]
    return score_in_batches(df, fn, text_col, out_col or name, out_type, error_col=error_col)
