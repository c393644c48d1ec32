"""Registered text, page and topic queries over ``documents``, ``pages`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import html as hx
from newslens.functions import text as tx
from newslens.functions.scores import spark_stopwords
from newslens.operators import enrich, entities as ent, topics
from newslens.operators.cleaning import clean_articles, clean_content, drop_null_text
from newslens.functions import patterns as P
from newslens.plans import sqltext as S
from newslens.sources.paged import url_batches
from newslens.sources.tables import spread, table

# Number of clusters for the registered clustering query (the embeddings carry 10 labels).
TEST_CLUSTERS = 10
# How often the label's words stand in front of a text of `labelled_text`.
LABEL_REPEATS = 20
# Names put in front of the texts of `source_entities`, and how often.
MENTIONS = ("Der Olaf Scholz", "Berlin", "Deutsche Bahn", "Nord See", "Robert Habeck")
MENTION_REPEATS = 12
# Page size of the registered paged scans, and the offsets of the one over a range.
BATCH_SIZE = 100
BATCH_RANGE = (20, 190)
# Parts of the raw articles of `raw_articles`.
RAW_OUTLETS = (*fixed.ALLOWED_OUTLETS[:4], "not-listed")
GERMAN = " ".join(fixed.GERMAN_MARKER_WORDS[:fixed.GERMAN_MIN_WORDS + 2]) + " "
RAW_PARTS = (f" {fixed.NON_ARTICLE_SNIPPETS[2]} und {fixed.NON_ARTICLE_SNIPPETS[0]} Ende",
             f" {fixed.TRIM_AFTER_PHRASES[1]} weg damit", " siehe https://x.de/a?b=1 oder \u00a9 2024 und \u00a92023   Schluss")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def document_tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_tokens(documents(spark, sf_dir), "text")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumnRenamed("text", "content")
    d = d.dropna(how="any", subset=["doc_id", "lang", "source", "n_chars"])
    return drop_null_text(clean_content(d, "content"), "content").select("doc_id", "source", "content")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = document_tokens_df(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), "processed_content",
                    "processed_content_truncated")


def document_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = enrich.lexicon_sentiment(document_tokens_df(spark, sf_dir))
    return t.select("doc_id", "sentiment_score", "sentiment")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.class_tfidf(document_tokens_df(spark, sf_dir), "source")


def topic_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_tokens_df(spark, sf_dir)
    return topics.topic_probabilities(d, topics.class_tfidf(d, "source", top_n=PROBABILITY_TERMS), "doc_id")


#: Terms that stand for a topic in the probabilities.
PROBABILITY_TERMS = 100


def topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_info(document_tokens_df(spark, sf_dir), "source")


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a candidate label's words put in front of each text, the label chosen by the source's number:
    the test texts hold none of their words."""
    n = F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    label = F.element_at(F.array(*map(F.lit, fixed.DISTINCT_TOPIC_LABELS)), n * 2 % len(fixed.DISTINCT_TOPIC_LABELS) + 1)
    return documents(spark, sf_dir).withColumn("text", F.concat(F.repeat(F.concat(label, F.lit(" ")), LABEL_REPEATS), "text"))


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = topics.class_tfidf(enrich.with_tokens(labelled_text(spark, sf_dir), "text"), "source")
    return topics.label_topics(reps, topics.label_dim(spark))


def source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top entities per outlet, with their labels from a gazetteer table, in texts that each name one of a few people,
    places and organisations several times (chosen by ``doc_id``)."""
    n = (F.col("doc_id") % len(MENTIONS)).cast("int") + 1
    named = F.repeat(F.concat(F.element_at(F.array(*map(F.lit, MENTIONS)), n), F.lit(", ")), MENTION_REPEATS)
    d = documents(spark, sf_dir).withColumn("text", F.concat(named, "text"))
    m = d.where(F.col("source").isNotNull()).select(
        F.col("source").alias("topic"), F.explode(ent.capitalised_entities("text", stop=STOP)["text"]).alias("entity"))
    top = ent.top_entities(m.groupBy("topic", "entity").agg(F.count("*").alias("n_mentions")))
    gazetteer = spark.createDataFrame(list(ent.GAZETTEER.items()), "name string, label string")
    return ent.label_mentions(top, gazetteer).select("topic", "rank", "entity", "label", "n_mentions")


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topics.cluster_topics(e, "embedding", k=TEST_CLUSTERS).select("vec_id", "label", "topic_nr")


def page_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    outlet = tx.outlet_from_url("url")
    return p.select("page_id", "url", outlet.alias("outlet"), hx.extraction_method("url").alias("method"),
                    outlet.isin(*fixed.ALLOWED_OUTLETS).alias("allowed"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The test pages hold few character references and no link paragraphs: put some behind every paragraph start.
    p = pages(spark, sf_dir).withColumn("method", hx.extraction_method("url")) \
        .withColumn("html", F.replace("html", F.lit("<p>"), F.lit(RICH_PARAGRAPH)))
    # A page without a URL gets no content (the fetch is skipped).
    has_url = F.col("url").isNotNull() & (F.col("url") != "")
    return p.select("page_id", "url", "method", F.when(has_url, hx.page_text("html", "method")).alias("content"))


RICH_PARAGRAPH = ('<p><a href="/x">mostly a link &raquo;</a> &hellip;</p><p>f&uuml;r &Ouml;l &#8222;x&#8220; &ndash; &szlig; &#x201C;&#150; '
                  "&nope; &amp;lt; &#0; &#55296; &euro;5 & so on &alpha</p><p>")


def _batches(spark: SparkSession, sf_dir: str, start: int, end: int | None) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_batches(p, "url", tie=["page_id"], start=start, end=end, size=BATCH_SIZE) \
        .select("url", "page_id", "position", "batch_start", "batch_end")


def page_url_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, 0, None)


def page_url_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paged scan between two offsets: the last page starts below the end and is read in full."""
    return _batches(spark, sf_dir, *BATCH_RANGE)


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-row entity count map of every document, a row per key."""
    d = documents(spark, sf_dir).select("doc_id", ent.capitalised_entities("text", stop=STOP).alias("entities"))
    return d.select("doc_id", F.explode(ent.entity_count_map("entities")).alias("entity", "n_mentions"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged headline rows over ``documents`` with everything the cleaning chain looks for, chosen by ``doc_id``: URLs
    that repeat or are missing, other outlets, missing fields, date texts, snippets, trim phrases, URLs, copyright years,
    broken encoding, blank and foreign texts."""
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    key = F.when(d % 5 == 1, d - 1).otherwise(d)
    outlet = F.element_at(F.array(*map(F.lit, RAW_OUTLETS)), (key % len(RAW_OUTLETS)).cast("int") + 1)
    german = F.when(d % 3 > 0, F.concat(F.lit(GERMAN), "text")).otherwise(F.col("text"))
    content = (F.when(d % 8 == 1, F.concat(german, F.lit(RAW_PARTS[0])))
               .when(d % 8 == 2, F.concat(german, F.lit(RAW_PARTS[1])))
               .when(d % 8 == 3, F.concat(german, F.lit(RAW_PARTS[2])))
               .when(d % 8 == 4, F.concat(F.lit(fixed.MOJIBAKE_MARKER), german))
               .when(d % 8 == 5, F.lit(" \n\t ")).when(d % 8 == 6, F.lit(None)).otherwise(german))
    date = F.when(d % 11 == 0, F.lit(None)).when(d % 7 == 0, F.concat(F.lit("2024-03-0"), (d % 9 + 1).cast("string"), F.lit("T10:00:00+01:00"))) \
        .otherwise(F.concat(F.lit("2024-02-1"), (d % 10).cast("string"), F.lit(" 08:30:00")))
    return documents(spark, sf_dir).select(
        F.when(d % 17 != 0, F.concat(F.lit("T"), n)).alias("title"), F.lit("feed").alias("source"),
        F.when(d % 13 != 0, F.concat(F.lit("https://www."), outlet, F.lit(".de/"), key.cast("string"))).alias("url"),
        date.alias("publishedAt"), F.concat(F.lit("about "), n).alias("description"), content.alias("content"),
        d.alias("ingest_seq"))


def clean_article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_articles(raw_articles(spark, sf_dir)).select("title", "source", "url", "datetime", "description", "content")


SPARK = {
    "clean_documents": clean_documents,
    "document_tokens": document_tokens,
    "document_sentiment": document_sentiment,
    "topic_terms": topic_terms,
    "topic_info": topic_info,
    "topic_probabilities": topic_probabilities,
    "topic_labels": topic_labels,
    "topic_clusters": topic_clusters,
    "source_entities": source_entities,
    "page_outlets": page_outlets,
    "page_text": page_text,
    "page_url_batches": page_url_batches,
    "page_url_range": page_url_range,
    "document_entities": document_entities,
    "clean_articles": clean_article_rows,
}

STOP = spark_stopwords("german")
_TOK = f"tok AS (SELECT doc_id, source, {S.tokens('text', STOP)} AS t FROM documents)"
LABELLED = f"""SELECT doc_id, source, repeat({S.str_list(fixed.DISTINCT_TOPIC_LABELS)}[
  coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER), 0) * 2 % {len(fixed.DISTINCT_TOPIC_LABELS)} + 1]
  || ' ', {LABEL_REPEATS}) || text AS text FROM documents"""


def _terms(source: str = "documents") -> str:
    return f"""WITH tok AS (SELECT doc_id, source, {S.tokens('text', STOP)} AS t FROM {source}),
terms AS (SELECT source AS topic, unnest(t) AS term FROM tok
          UNION ALL
          SELECT source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok
          WHERE len(t) >= 2),
tc AS (SELECT topic, term, count(*) AS tf FROM terms GROUP BY ALL),
pc AS (SELECT topic, sum(tf) AS class_words FROM tc GROUP BY topic),
pa AS (SELECT *, floor(avg(class_words) OVER ()) AS avg_words FROM pc),
pt AS (SELECT term, sum(tf) AS term_freq FROM tc GROUP BY term),
sc AS (SELECT tc.topic, tc.term,
              (CAST(tf AS DOUBLE) / CAST(class_words AS DOUBLE))
              * ln(CAST(avg_words AS DOUBLE) / CAST(term_freq AS DOUBLE) + 1.0::DOUBLE) AS score
       FROM tc JOIN pt USING (term) JOIN pa USING (topic)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM sc),
top AS (SELECT topic, CAST(rank AS INTEGER) AS rank, term, {S.round9('score')} AS score
        FROM r WHERE rank <= {fixed.TOP_TOPIC_WORDS})"""


def _grams(word: str) -> str:
    return (f"list_transform(range(1, greatest(length('<' || {word} || '>') - {topics.GRAM - 1}, 1) + 1), "
            f"lambda i: substr('<' || {word} || '>', i, {topics.GRAM}))")


def topic_label_ctes(source: str) -> str:
    """CTEs from the tokens of ``source`` to ``top`` (topic terms) and ``best`` (labels by rank ``rn`` per topic)."""
    return f"""{_terms(source).removeprefix("WITH ")},
words AS (SELECT DISTINCT topic, unnest(string_split(term, ' ')) AS word FROM top),
grams AS (SELECT DISTINCT topic, unnest({_grams('word')}) AS gram FROM words),
lw AS (SELECT label, list_distinct(flatten(list_transform({S.tokens('label', STOP, 2, topics.LABEL_WORD_MAX)}, lambda v: {_grams('v')})))
       AS gs FROM {_LABELS}),
labels AS (SELECT label, unnest(gs) AS gram, len(gs) AS label_grams FROM lw),
hits AS (SELECT topic, label, label_grams, count(*) AS matched FROM grams JOIN labels USING (gram) GROUP BY ALL),
ls AS (SELECT *, CAST(matched AS DOUBLE) / CAST(label_grams AS DOUBLE) AS score FROM hits),
best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score < {fixed.TOPIC_LABEL_CUTOFF}, score * matched DESC, label) AS rn
         FROM ls)"""


_TERMS = _terms()
_LABELS = "(VALUES " + ", ".join(f"({S.q(lab)})" for lab in fixed.DISTINCT_TOPIC_LABELS) + ") AS v(label)"

_PAGES = f"""WITH p AS (SELECT *, {S.extraction_method('url')} AS method, {S.strip_non_content(f"replace(html, '<p>', {S.q(RICH_PARAGRAPH)})")} AS clean
           FROM pages)"""

_POSITIONS = "WITH r AS (SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS position FROM pages)"

ORACLE = {
    "clean_documents": f"""WITH s1 AS (SELECT doc_id, lang, source, n_chars, {S.null_if_mojibake('text')} AS c1 FROM documents),
s2 AS (SELECT *, {S.null_unless_german('c1')} AS c2 FROM s1),
s3 AS (SELECT *, {S.remove_snippets('c2')} AS c3 FROM s2),
s4 AS (SELECT *, {S.trim_after('c3')} AS c4 FROM s3),
s5 AS (SELECT *, {S.clean_text('c4')} AS c5 FROM s4),
s6 AS (SELECT *, {S.null_if_blank('c5')} AS content FROM s5)
SELECT doc_id, source, content FROM s6
WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL
  AND content IS NOT NULL""",

    "document_tokens": f"""WITH {_TOK}
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS processed_content,
       array_to_string(t[1:{fixed.MODEL_MAX_TOKENS}], ' ') AS processed_content_truncated
FROM tok""",

    "document_sentiment": f"""WITH {_TOK},
s AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(t, lambda w:
        CASE WHEN list_contains({S.str_list(enrich.POSITIVE_WORDS)}, w) THEN 1
             WHEN list_contains({S.str_list(enrich.NEGATIVE_WORDS)}, w) THEN -1 ELSE 0 END)), 0) AS INTEGER)
        AS sentiment_score FROM tok)
SELECT doc_id, sentiment_score,
       CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative'
            ELSE 'neutral' END AS sentiment
FROM s""",

    "topic_terms": f"""{_TERMS}
SELECT topic, rank, term, score FROM top""",

    "topic_probabilities": f"""{_TERMS.replace(f'<= {fixed.TOP_TOPIC_WORDS}', f'<= {PROBABILITY_TERMS}')},
unit AS (SELECT topic, term, score / sqrt(sum(score * score) OVER (PARTITION BY topic)) AS s FROM top),
doc AS (SELECT doc_id, t, least(len(t), 4) AS w FROM tok WHERE len(t) > 0 AND doc_id IS NOT NULL),
normed AS (SELECT doc_id, t, w, list_transform(range(1, len(t) - w + 2), lambda i: sqrt(list_sum(list_transform(
  t[i:i + w - 1], lambda x: len(list_filter(t[i:i + w - 1], lambda y: y = x)))))) AS n FROM doc),
tokens AS (SELECT doc_id, t, w, n, unnest(range(1, len(t) + 1)) AS p FROM normed),
factors AS (SELECT doc_id, t[p] AS term, list_sum(list_transform(n[greatest(p - w + 1, 1):least(p, len(n))], lambda z: w / z)) AS f FROM tokens),
sums AS (SELECT doc_id, topic, sum(f * s) AS p FROM factors JOIN unit USING (term) GROUP BY ALL)
SELECT doc_id, topic, round_even(p / sum(p) OVER (PARTITION BY doc_id), 6) AS probability FROM sums""",

    "topic_info": f"""{_TERMS},
rep AS (SELECT topic, string_agg(term, ' ' ORDER BY rank) AS representation FROM top GROUP BY topic),
sizes AS (SELECT source AS topic, count(*) AS n_docs FROM documents GROUP BY source)
SELECT sizes.topic, n_docs, representation FROM sizes LEFT JOIN rep USING (topic)""",

    "topic_labels": f"""WITH {topic_label_ctes(f"({LABELLED})")}
SELECT t.topic, CASE WHEN score >= {fixed.TOPIC_LABEL_CUTOFF} THEN label ELSE 'None' END AS label,
       {S.round9('coalesce(score, 0.0)')} AS score
FROM (SELECT DISTINCT topic FROM top) t LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (topic)""",

    "source_entities": f"""WITH d AS (SELECT source AS topic, repeat({S.str_list(MENTIONS)}[doc_id % {len(MENTIONS)} + 1] || ', ',
  {MENTION_REPEATS}) || text AS text FROM documents WHERE source IS NOT NULL),
w AS (SELECT topic, unnest({S.entity_spans('text', STOP)}) AS entity FROM d),
c AS (SELECT topic, entity, count(*) AS n_mentions FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n_mentions DESC, entity) AS rank FROM c)
SELECT topic, CAST(rank AS INTEGER) AS rank, entity, coalesce(label, 'MISC') AS label, n_mentions
FROM r LEFT JOIN (VALUES {', '.join(f"({S.q(k)}, {S.q(v)})" for k, v in ent.GAZETTEER.items())}) AS g(name, label) ON lower(entity) = name
WHERE rank <= {fixed.TOP_ENTITIES}""",

    "page_outlets": f"""SELECT page_id, url, {S.outlet('url')} AS outlet, {S.extraction_method('url')} AS method,
       {S.outlet('url')} IN ({', '.join(S.q(o) for o in fixed.ALLOWED_OUTLETS)}) AS allowed
FROM pages""",

    "page_text": f"""{_PAGES}
SELECT page_id, url, method,
       CASE WHEN url IS NOT NULL AND url <> '' THEN
       {S.paragraph_text(f"CASE WHEN method = 'paragraph' THEN clean ELSE {S.article_block('clean')} END", "method = 'article'")} END AS content
FROM p""",

    "page_url_batches": f"""{_POSITIONS}
SELECT url, page_id, position, (position // {BATCH_SIZE}) * {BATCH_SIZE} AS batch_start,
       (position // {BATCH_SIZE}) * {BATCH_SIZE} + {BATCH_SIZE} AS batch_end
FROM r""",

    "page_url_range": f"""{_POSITIONS},
b AS (SELECT *, {BATCH_RANGE[0]} + ((position - {BATCH_RANGE[0]}) // {BATCH_SIZE}) * {BATCH_SIZE} AS batch_start FROM r
      WHERE position >= {BATCH_RANGE[0]})
SELECT url, page_id, position, batch_start, batch_start + {BATCH_SIZE} AS batch_end FROM b WHERE batch_start < {BATCH_RANGE[1]}""",

    "document_entities": f"""WITH w AS (SELECT doc_id, unnest({S.entity_spans('text', STOP)}) AS entity FROM documents)
SELECT doc_id, entity, count(*) AS n_mentions FROM w GROUP BY ALL""",

    "clean_articles": f"""WITH k AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN doc_id - 1 ELSE doc_id END AS key,
  CASE WHEN doc_id % 3 > 0 THEN {S.q(GERMAN)} || text ELSE text END AS g FROM documents),
raw AS (SELECT CASE WHEN doc_id % 17 <> 0 THEN 'T' || doc_id END AS title,
  CASE WHEN doc_id % 13 <> 0 THEN 'https://www.' || {S.str_list(RAW_OUTLETS)}[key % {len(RAW_OUTLETS)} + 1] || '.de/' || key END AS url,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '2024030' || (doc_id % 9 + 1) || '100000'
       ELSE '2024021' || (doc_id % 10) || '083000' END AS datetime,
  'about ' || doc_id AS description,
  CASE doc_id % 8 WHEN 1 THEN g || {S.q(RAW_PARTS[0])} WHEN 2 THEN g || {S.q(RAW_PARTS[1])} WHEN 3 THEN g || {S.q(RAW_PARTS[2])}
       WHEN 4 THEN {S.q(fixed.MOJIBAKE_MARKER)} || g WHEN 5 THEN ' ' WHEN 6 THEN NULL ELSE g END AS c, doc_id FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS rn FROM raw),
s1 AS (SELECT *, {S.null_if_mojibake('c')} AS c1 FROM f WHERE rn = 1 AND title IS NOT NULL AND url IS NOT NULL),
s2 AS (SELECT *, {S.null_unless_german('c1')} AS c2 FROM s1),
s3 AS (SELECT *, {S.remove_snippets('c2')} AS c3 FROM s2),
s4 AS (SELECT *, {S.trim_after('c3')} AS c4 FROM s3),
s5 AS (SELECT *, {S.clean_text('c4')} AS c5 FROM s4),
s6 AS (SELECT *, {S.null_if_blank('c5')} AS content, {S.outlet('url')} AS source FROM s5)
SELECT title, source, url, datetime, description, content FROM s6
WHERE content IS NOT NULL AND source IN ({', '.join(S.q(o) for o in fixed.ALLOWED_OUTLETS)})""",
}
