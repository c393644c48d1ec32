"""HTML → article text with native regex functions (no DOM parser).

A page is cleaned of comments, scripts and styles, split at every opening
``<p>`` tag and each piece is cut at its paragraph end (``</p>``, the end of an
enclosing block, or the end of the page). Unclosed paragraphs therefore end
where the next one starts; a DOM parser would nest them and repeat the inner
text inside the outer one, which is not reproduced.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import patterns as P

# Named character references: all of HTML 4 (Latin-1, symbols, Greek, typographic signs), and the apostrophe.
NAMED = {**{name: chr(cp) for name, cp in name2codepoint.items()}, "apos": "'"}
# Numbers 128 to 159 stand for the Windows-1252 characters, as in browsers; those without one keep their meaning.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
# Paragraphs of the main article that count: at least this long, and not mostly links.
MIN_PARAGRAPH_CHARS = 25
MAX_LINK_SHARE = 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_non_content(html) -> Column:
    h = F.regexp_replace(_c(html), P.HTML_COMMENT, "")
    h = F.regexp_replace(h, P.HTML_SCRIPT, "")
    return F.regexp_replace(h, P.HTML_STYLE, "")


def _char(code) -> Column:
    """The character of a code point (a bigint column), for any plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(c) -> Column:
    """Character references decoded once, from left to right (``&amp;lt;`` gives ``&lt;``): HTML 4 names, decimal and
    hexadecimal numbers, each closed by ``;``. Anything else after ``&`` stays as it is, and so do numbers that
    are no character (0, surrogates, beyond U+10FFFF)."""
    names = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    windows = F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv])

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, P.CHAR_REF, 1)
        digits = F.regexp_extract(ref, "^#([0-9]+)$", 1)
        hexes = F.regexp_extract(ref, "^#[xX]([0-9A-Fa-f]+)$", 1)
        code = F.when(digits != "", digits.try_cast("bigint")).when(hexes != "", F.conv(hexes, 16, 10).try_cast("bigint"))
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.when(code.isNotNull(), F.when(real, F.coalesce(F.element_at(windows, code.cast("int")), _char(code)))) \
            .otherwise(F.element_at(names, ref))
        return F.when((ref != "") & char.isNotNull(), F.concat(char, F.substring(piece, F.length(ref) + 2, F.length(piece)))) \
            .otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(_c(c), "&")
    return F.when(F.instr(_c(c), "&") == 0, _c(c)).otherwise(F.concat(
        F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), "")))


def _bodies(html) -> Column:
    pieces = F.split(_c(html), P.P_OPEN)
    bodies = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(bodies, lambda b: F.regexp_extract(b, P.P_BODY, 1))


def _is_content(body: Column) -> Column:
    """Long enough, and at most half of it inside links."""
    size = F.length(F.regexp_replace(body, P.TAG, ""))
    linked = F.length(F.regexp_replace(F.array_join(F.regexp_extract_all(body, F.lit(P.LINK), 1), ""), P.TAG, ""))
    return (size >= MIN_PARAGRAPH_CHARS) & (linked <= size * MAX_LINK_SHARE)


def paragraphs_of_clean(html, content_only=None) -> Column:
    """Paragraph texts of markup already stripped of comments, scripts and styles; where ``content_only`` is true,
    without paragraphs that are short or mostly links."""
    bodies = _bodies(html)
    if content_only is not None:
        bodies = F.when(content_only, F.filter(bodies, _is_content)).otherwise(bodies)
    return F.transform(bodies, lambda b: unescape(F.regexp_replace(b, P.TAG, "")))


def paragraphs(html) -> Column:
    """Array of paragraph texts (tags removed, entities decoded), in page order."""
    return paragraphs_of_clean(strip_non_content(html))


def paragraph_text(html) -> Column:
    """All paragraph texts joined by one space; NULL html gives NULL."""
    return F.array_join(paragraphs(html), " ")


def article_block(html) -> Column:
    """Markup inside the first ``<article>`` element, or the whole page when there is none."""
    inner = F.regexp_extract(_c(html), P.ARTICLE_BLOCK, 1)
    return F.when(inner != "", inner).otherwise(_c(html))


def extraction_method(url, hosts: Sequence[str] = fixed.PARAGRAPH_HOSTS) -> Column:
    """``paragraph`` for the listed hosts (substring test on the URL), else ``article``."""
    u = _c(url)
    hit = reduce(lambda a, b: a | b, [F.instr(u, h) > 0 for h in hosts])
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("paragraph")).otherwise(F.lit("article"))


def page_text(html, method) -> Column:
    """Paragraph method: every ``<p>`` of the page. Article method: the paragraphs of the main ``<article>`` element
    (navigation, ads and footers dropped) that are not short or mostly links."""
    clean = strip_non_content(html)
    whole = _c(method) == "paragraph"
    return F.array_join(paragraphs_of_clean(F.when(whole, clean).otherwise(article_block(clean)), ~whole), " ")
