"""SQL (DuckDB dialect) text of the library's expressions, for the oracle queries."""

from __future__ import annotations

from typing import Sequence

from newslens import fixed
from newslens.functions import patterns as P
from newslens.functions.html import MAX_LINK_SHARE, MIN_PARAGRAPH_CHARS, NAMED, WINDOWS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def rx_replace(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def null_if_mojibake(expr: str) -> str:
    return f"CASE WHEN NOT contains({expr}, {q(fixed.MOJIBAKE_MARKER)}) THEN {expr} END"


def german_hits(expr: str, words: Sequence[str] = fixed.GERMAN_MARKER_WORDS) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({expr}), {q(w)}) AS INTEGER)" for w in words) + ")"


def null_unless_german(expr: str) -> str:
    return f"CASE WHEN {german_hits(expr)} >= {fixed.GERMAN_MIN_WORDS} THEN {expr} END"


def remove_snippets(expr: str, snippets: Sequence[str] = fixed.NON_ARTICLE_SNIPPETS) -> str:
    for s in snippets:
        expr = f"replace({expr}, {q(s)}, '')"
    return expr


def trim_after(expr: str, phrases: Sequence[str] = fixed.TRIM_AFTER_PHRASES) -> str:
    whens = " ".join(f"WHEN contains({expr}, {q(p)}) THEN split_part({expr}, {q(p)}, 1)" for p in phrases)
    return f"CASE {whens} ELSE {expr} END"


def clean_text(expr: str) -> str:
    e = rx_replace(expr, P.URL_RUN)
    e = rx_replace(e, P.COPYRIGHT_YEAR)
    return rx_replace(e, P.WS + "+", " ")


def null_if_blank(expr: str) -> str:
    return f"CASE WHEN NOT regexp_matches({expr}, {q(P.BLANK)}) THEN {expr} END"


def outlet(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, {q(P.OUTLET)}, 1), '')"


def tokens(expr: str, stop: Sequence[str] | None = None, min_len: int = fixed.TOKEN_MIN_LEN,
           max_len: int = fixed.TOKEN_MAX_LEN) -> str:
    t = rx_replace(expr, P.DIGIT + "+")
    t = f"lower({rx_replace(t, P.NON_WORD, ' ')})"
    cond = (f"length(w) >= {min_len} AND length(w) <= {max_len} "
            f"AND NOT starts_with(w, '_')")
    if stop is not None:
        cond += f" AND NOT list_contains({str_list(stop)}, w)"
    return f"list_filter(regexp_split_to_array({t}, {q(P.NON_WORD + '+')}), lambda w: {cond})"


def unescape(expr: str) -> str:
    """Pieces after each '&': a named or numbered reference at the start of a piece gives its character."""
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMED.items()) + "}"
    windows = "MAP {" + ", ".join(f"{k}: {q(v)}" for k, v in WINDOWS.items()) + "}"
    ref = f"regexp_extract(x, {q(P.CHAR_REF)}, 1)"
    code = (f"(CASE WHEN regexp_matches({ref}, '^#[0-9]') THEN CAST(substr({ref}, 2) AS BIGINT) "
            f"WHEN starts_with(lower({ref}), '#x') THEN CAST('0x' || substr({ref}, 3) AS BIGINT) END)")
    real = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    char = (f"CASE WHEN starts_with({ref}, '#') THEN (CASE WHEN {real} THEN coalesce({windows}[CAST({code} AS INTEGER)], "
            f"chr(CAST({code} AS INTEGER))) END) ELSE {names}[{ref}] END")
    return (f"array_to_string(list_transform(string_split({expr}, '&'), lambda x, i: CASE WHEN i = 1 THEN x "
            f"WHEN {ref} <> '' AND ({char}) IS NOT NULL THEN ({char}) || substr(x, length({ref}) + 2) ELSE '&' || x END), '')")


def strip_non_content(expr: str) -> str:
    return rx_replace(rx_replace(rx_replace(expr, P.HTML_COMMENT), P.HTML_SCRIPT), P.HTML_STYLE)


def paragraph_text(expr: str, content_only: str = "false") -> str:
    """Paragraph text of markup already stripped of comments, scripts and styles; where the condition holds, without
    paragraphs that are short or mostly links."""
    bodies = f"list_transform((string_split_regex({expr}, {q(P.P_OPEN)}))[2:], lambda b: regexp_extract(b, {q(P.P_BODY)}, 1))"
    size = f"length({rx_replace('b', P.TAG)})"
    links = f"array_to_string(regexp_extract_all(b, {q(P.LINK)}, 1), '')"
    keep = (f"NOT ({content_only}) OR ({size} >= {MIN_PARAGRAPH_CHARS} AND "
            f"length({rx_replace(links, P.TAG)}) <= {size} * {MAX_LINK_SHARE})")
    return (f"array_to_string(list_transform(list_filter({bodies}, lambda b: {keep}), "
            f"lambda b: {unescape(rx_replace('b', P.TAG))}), ' ')")


def article_block(expr: str) -> str:
    inner = f"regexp_extract({expr}, {q(P.ARTICLE_BLOCK)}, 1)"
    return f"CASE WHEN {inner} <> '' THEN {inner} ELSE {expr} END"


def extraction_method(expr: str, hosts: Sequence[str] = fixed.PARAGRAPH_HOSTS) -> str:
    cond = " OR ".join(f"contains({expr}, {q(h)})" for h in hosts)
    return f"CASE WHEN coalesce({cond}, false) THEN 'paragraph' ELSE 'article' END"


def round9(expr: str) -> str:
    return f"round_even(({expr}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE"


def entity_spans(expr: str, stop: Sequence[str]) -> str:
    """List of the capitalised runs of a text without their stop words."""
    spans = f"regexp_extract_all({expr}, {q(P.CAPITALISED_RUN)}, 1)"
    words = f"list_filter(string_split(s, ' '), lambda w: NOT list_contains({str_list(stop)}, lower(w)))"
    return f"list_filter(list_transform({spans}, lambda s: array_to_string({words}, ' ')), lambda s: s <> '')"
