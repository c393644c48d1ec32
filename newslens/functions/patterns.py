"""Regular-expression building blocks shared by the Spark code and the SQL oracle.

Java's ``\\s``/``\\d``/``\\w`` are ASCII-only, Python's are Unicode. The classes
below spell out the Unicode sets explicitly so the same pattern text means the
same thing in Java regex (Spark) and RE2 (the DuckDB oracle).
"""

# Python's str.isspace() set: ASCII controls, U+001C-001F, U+0085 and every
# Unicode separator (Zs, Zl, Zp).
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NOT_WS = r"[^\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# Python's \d on str: decimal digits of any script.
DIGIT = r"\p{Nd}"
# Python's \w on str: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

URL_RUN = r"http" + NOT_WS + "+"
COPYRIGHT_YEAR = r"©" + WS + "?" + DIGIT + "+"
BLANK = r"^" + WS + r"*\z"
OUTLET = r"https?://(?:www\.)?([\p{L}\p{N}_-]+)\."
DIGIT_DATE = r"^" + DIGIT + "{8,}"
ALL_ASCII_DIGITS = r"^[0-9]+\z"

# HTML paragraph extraction. No back-references and no look-around, so RE2
# accepts the same text.
HTML_COMMENT = r"(?is)<!--.*?-->"
HTML_SCRIPT = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>"
HTML_STYLE = r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>"
P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
# A paragraph runs to its own end tag, the end of an enclosing block, or the end.
P_BODY = r"(?is)^(.*?)(?:</p\s*>|</(?:div|body|article|main|section)\s*>|\z)"
TAG = r"(?s)<[^>]*>"
ARTICLE_BLOCK = r"(?is)<article(?:\s[^>]*)?>(.*?)(?:</article\s*>|\z)"
LINK = r"(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>"
CHAR_REF = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Words that start with an upper-case letter, joined by single spaces (group 1), after a non-word character.
CAPITALISED_RUN = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]+(?: \p{Lu}[\p{L}\p{N}_]+)*)"
