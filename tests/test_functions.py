"""Hand-made edge rows (null, tie, regex and order semantics)."""

from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import dates, html as hx, text as tx
from newslens.functions.scores import round_half_even, sentiment_score, spark_stopwords


def one(spark, value, expr, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_datetime_format(spark):
    assert one(spark, "2024-11-06T12:34:56+01:00", dates.format_datetime) == "20241106123456"
    assert one(spark, "2024-11-06T12:34:56Z", dates.format_datetime) == "20241106123456Z"
    assert one(spark, None, dates.format_datetime) is None


def test_month_floor(spark):
    rows = [("20231031120000",), ("20231101000000",), (None,), ("nan",), ("2024",), ("None",)]
    df = spark.createDataFrame(rows, "datetime string")
    kept = [r[0] for r in df.where(dates.month_floor_ok("datetime", 202311)).collect()]
    assert kept == ["20231101000000", None, "nan"]


def test_bad_month_gives_null(spark):
    assert one(spark, "20241301", dates.month_of) is None
    assert str(one(spark, "20241101", dates.month_of)) == "2024-11-01"


def test_digit_date(spark):
    assert one(spark, "20241106123456Z", dates.has_digit_date) is True
    assert one(spark, "2024110", dates.has_digit_date) is False
    assert one(spark, None, dates.has_digit_date) is False


def test_language_threshold(spark):
    four = "und der das ist"
    five = "und der das ist zu"
    assert one(spark, four, tx.null_unless_german) is None
    assert one(spark, five, tx.null_unless_german) == five
    # substring semantics: "es" inside "Messe" counts
    assert one(spark, "Messe", tx.german_word_hits) >= 1


def test_mojibake(spark):
    assert one(spark, "x" + fixed.MOJIBAKE_MARKER + "y", tx.null_if_mojibake) is None
    assert one(spark, "Ãx", tx.null_if_mojibake) == "Ãx"
    assert one(spark, None, tx.null_if_mojibake) is None


def test_snippet_order(spark):
    # 'dpa' is removed before '© dpa-infocom, ' gets a chance
    assert one(spark, "© dpa-infocom, X", tx.remove_snippets) == "© -infocom, X"


def test_trim_uses_list_order(spark):
    p0, p1 = fixed.TRIM_AFTER_PHRASES[0], fixed.TRIM_AFTER_PHRASES[1]
    text = f"A {p1} B {p0} C"
    assert one(spark, text, tx.trim_after) == f"A {p1} B "
    assert one(spark, "plain", tx.trim_after) == "plain"


def test_clean_text(spark):
    assert one(spark, "a http://x.y/z b©  2024\n\nc", tx.clean_text) == "a b© 2024 c"
    assert one(spark, "a  b", tx.clean_text) == "a b"


def test_blank(spark):
    assert one(spark, " ", tx.null_if_blank) is None
    assert one(spark, "", tx.null_if_blank) is None
    assert one(spark, " x ", tx.null_if_blank) == " x "


def test_outlet(spark):
    assert one(spark, "https://www.bild.de/x", tx.outlet_from_url) == "bild"
    assert one(spark, "https://sport.bild.de/x", tx.outlet_from_url) == "sport"
    assert one(spark, "ftp://x.y", tx.outlet_from_url) is None


def test_unicode_tokens(spark):
    toks = one(spark, "für_Öl 12 Straße a", tx.tokens)
    assert toks == ["für_öl", "straße"]
    stop = spark_stopwords("german")
    assert "und" in stop and len(stop) > 200
    from pyspark.ml.feature import StopWordsRemover
    assert list(stop) == StopWordsRemover.loadDefaultStopWords("german")
    kept = spark.createDataFrame([(["und", "krieg", "und"],)], "t array<string>") \
        .select(tx.drop_stopwords("t", stop).alias("r")).first()["r"]
    assert kept == ["krieg"]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(tx.unigrams_and_bigrams("t")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_rounding_half_even(spark):
    assert one(spark, 2.125, lambda c: round_half_even(c, 2), "double") == 2.12
    assert one(spark, 1.015, lambda c: round_half_even(c, 2), "double") == 1.01  # binary 1.01499…


def test_sentiment_score(spark):
    assert one(spark, "positive", sentiment_score) == 1
    assert one(spark, "negative", sentiment_score) == -1
    assert one(spark, "mixed", sentiment_score) is None


def test_html_paragraphs(spark):
    page = ("<html><head><script>var t='</p>';</script><style>p{}</style></head><body><nav><p>menu</p></nav>"
            "<!-- <p>hidden</p> --><article><p><b>Eins</b> &amp; zwei<br><p>drei</p></article>"
            "<footer><p>&copy; x</p></footer></body></html>")
    assert one(spark, page, hx.paragraph_text) == "menu Eins & zwei drei © x"
    df = spark.createDataFrame([(page, "article"), (page, "paragraph")], "h string, m string")
    got = [r[0] for r in df.select(hx.page_text("h", "m")).collect()]
    assert got == ["", "menu Eins & zwei drei © x"]  # the article's paragraphs are too short to be its text
    df = spark.createDataFrame([(page.replace("drei", "drei " * 9), "article")], "h string, m string")
    assert df.select(hx.page_text("h", "m")).first()[0].split() == ["drei"] * 9
    assert one(spark, None, hx.paragraph_text) is None


def test_character_references(spark):
    import html

    text = "<p>f&uuml;r &Ouml;l &#8222;x&#8220; &ndash; &szlig; &#x1F600;&#X41; &amp;lt; &nbsp;&thorn;&Omega;&apos;&#39;</p>"
    assert one(spark, text, hx.paragraph_text) == html.unescape(text)[3:-4]
    odd = "&; & &x; &#; &#0; &#55296; &#1114112; &#9999999; &#x110000; &uuml &#65 a&&amp;&"
    assert one(spark, f"<p>{odd}</p>", hx.paragraph_text) == odd.replace("&amp;", "&")
    assert one(spark, "<p>&#150;&#128;&#129;</p>", hx.paragraph_text) == "–€\x81"


def test_article_method_drops_short_and_link_paragraphs(spark):
    long = "This paragraph is long enough to count."
    page = (f"<article><p>{long}</p><p>short</p><p><a href='/a'>{long}</a> more</p><p>{long} <a>one <b>link</b></a></p></article>")
    df = spark.createDataFrame([(page, "article"), (page, "paragraph")], "h string, m string")
    got = [r[0] for r in df.select(hx.page_text("h", "m")).collect()]
    assert got == [f"{long} {long} one link", f"{long} short {long} more {long} one link"]


def test_extraction_method(spark):
    assert one(spark, "https://www.welt.de/a", hx.extraction_method) == "paragraph"
    assert one(spark, "https://www.spiegel.de/a", hx.extraction_method) == "article"
    assert one(spark, None, hx.extraction_method) == "article"
