"""Article-text expressions. Every function maps Column → Column and stays JVM-side."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(expr, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` (an expression-level ``let``).

    Steps that read their input several times (a test plus the value) would
    otherwise copy the whole upstream expression into every reference when
    Catalyst merges projections or pushes a filter through them, and a chain
    of such steps grows multiplicatively.
    """
    return F.get(F.transform(F.array(_c(expr)), fn), 0)


def null_if_mojibake(c, marker: str = fixed.MOJIBAKE_MARKER) -> Column:
    """NULL for texts that contain the mis-decoded umlaut run; NULL stays NULL."""
    return bind(c, lambda x: F.when(~x.contains(marker), x))


def german_word_hits(c, words: Sequence[str] = fixed.GERMAN_MARKER_WORDS) -> Column:
    """How many of ``words`` occur as substrings of the lower-cased text."""
    return bind(F.lower(_c(c)), lambda low: reduce(
        lambda a, b: a + b, [low.contains(w).cast("int") for w in words]))


def null_unless_german(c, words: Sequence[str] = fixed.GERMAN_MARKER_WORDS,
                       min_hits: int = fixed.GERMAN_MIN_WORDS) -> Column:
    """Keep a text only when at least ``min_hits`` marker words occur in it (substring test)."""
    return bind(c, lambda x: F.when(german_word_hits(x, words) >= min_hits, x))


def remove_snippets(c, snippets: Iterable[str] = fixed.NON_ARTICLE_SNIPPETS) -> Column:
    """Delete every snippet, one after the other, in list order (order matters: earlier
    short snippets can destroy later long ones).

    A fold over the snippet list; each step first tests ``contains`` (a
    first-byte scan) and only rewrites the text when the snippet occurs.
    """
    items = F.array(*[F.lit(s) for s in snippets])
    return F.aggregate(items, _c(c), lambda acc, s: F.when(acc.contains(s), F.replace(acc, s, F.lit("")))
                       .otherwise(acc))


def trim_after(c, phrases: Sequence[str] = fixed.TRIM_AFTER_PHRASES) -> Column:
    """Cut the text before the first occurrence of the first listed phrase that occurs."""
    return bind(c, lambda x: F.coalesce(*[F.when(x.contains(p), F.substring_index(x, p, 1))
                                          for p in phrases], x))


def clean_text(c) -> Column:
    """Drop URLs and ``© <digits>``, then collapse whitespace runs to one space.

    The original also turns newline runs into a space before collapsing
    whitespace; that step cannot change the result of the collapse, so it is
    not evaluated.
    """
    c = F.regexp_replace(_c(c), P.URL_RUN, "")
    c = F.regexp_replace(c, P.COPYRIGHT_YEAR, "")
    return F.regexp_replace(c, P.WS + "+", " ")


def null_if_blank(c) -> Column:
    return bind(c, lambda x: F.when(~x.rlike(P.BLANK), x))


def outlet_from_url(c) -> Column:
    """``https://www.bild.de/x`` → ``bild``; ``https://sport.bild.de`` → ``sport``; no match → NULL."""
    return F.nullif(F.regexp_extract(_c(c), P.OUTLET, 1), F.lit(""))


def tokens(c, min_len: int = fixed.TOKEN_MIN_LEN, max_len: int = fixed.TOKEN_MAX_LEN) -> Column:
    """Digits removed, non-word characters to spaces, lower-cased, split into words of
    ``min_len``..``max_len`` characters that do not start with ``_``."""
    # Replacing each non-word character by a space before splitting at
    # non-word runs cannot change the pieces (lower-casing maps no non-word
    # character to a word character), so the split does both in one pass.
    t = F.lower(F.regexp_replace(_c(c), P.DIGIT + "+", ""))
    words = F.split(t, P.NON_WORD + "+")
    return F.filter(words, lambda w: (F.length(w) >= min_len) & (F.length(w) <= max_len)
                    & ~w.startswith("_"))


def char_grams(word, n: int = 4) -> Column:
    """Character n-grams of ``<word>``; a word that is too short for one gives itself between the marks."""
    marked = F.concat(F.lit("<"), _c(word), F.lit(">"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))),
                       lambda i: F.substring(marked, i, F.lit(n)))


def drop_stopwords(tok, stop: Sequence[str]) -> Column:
    """Remove stop words, keeping order and repeats (``isin`` becomes a hash-set lookup)."""
    return F.filter(_c(tok), lambda w: ~w.isin(*stop))


def join_tokens(tok) -> Column:
    return F.array_join(_c(tok), " ")


def truncate_tokens(tok, n: int = fixed.MODEL_MAX_TOKENS) -> Column:
    return F.slice(_c(tok), 1, n)


def bigrams(tok) -> Column:
    """Adjacent token pairs joined by a space (the stop words are already gone)."""
    tok = _c(tok)
    pairs = F.transform(F.sequence(F.lit(1), F.size(tok) - 1),
                        lambda i: F.concat_ws(" ", F.element_at(tok, i), F.element_at(tok, i + 1)))
    return F.when(F.size(tok) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def unigrams_and_bigrams(tok) -> Column:
    tok = _c(tok)
    return F.concat(tok, bigrams(tok))
