"""Numeric helpers: sentiment scores, pandas-style rounding, safe shares."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_score(c, mapping: dict = fixed.SENTIMENT_SCORES) -> Column:
    """positive → 1, neutral → 0, negative → -1, anything else → NULL."""
    c = _c(c)
    expr = None
    for label, score in mapping.items():
        expr = (F.when(c == label, F.lit(score)) if expr is None
                else expr.when(c == label, F.lit(score)))
    return expr


def round_half_even(c, digits: int = 2) -> Column:
    """Round like numpy/pandas: scale, round half to even on the binary value, unscale.

    ``F.bround`` rounds the decimal text of the double instead and differs on
    values such as 1.015 (binary 1.01499…).
    """
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def share(part, total) -> Column:
    """``part / total`` as double; a zero total gives NULL instead of an ANSI error."""
    return F.try_divide(_c(part).cast("double"), _c(total).cast("double"))


@lru_cache(maxsize=None)
def spark_stopwords(language: str = "german") -> tuple[str, ...]:
    """A stop-word list shipped as package data (the public Snowball German list that Spark ML uses too)."""
    text = resources.files("newslens").joinpath("data", f"{language}_stopwords.txt").read_text(encoding="utf-8")
    return tuple(w.strip() for w in text.splitlines() if w.strip())
