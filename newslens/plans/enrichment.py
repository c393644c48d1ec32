"""Registered article-enrichment queries: merge by URL, leanings, entities, related topics,
headline flattening and windowed coverage, over the article view of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import dates
from newslens.operators import entities as ent
from newslens.operators.dedupe import merge_history
from newslens.operators.enrich import assign_leaning
from newslens.plans import sqltext as S
from newslens.sources.articles import ARTICLE_VIEW_SQL, article_view, leaning_of_nation
from newslens.sources.headlines import parse_responses, select_headlines
from newslens.sources.tables import table
from newslens.streaming.coverage import article_ts, coverage_windows, utc_day

# The stored history holds the articles dated before 1998, the new batch those
# from 1997 on: the year 1997 arrives twice and must keep its stored rows.
HISTORY_BEFORE = "19980101"
NEW_FROM = "19970101"
# Articles per landed API response page (the request's page size).
RESPONSE_PAGE = fixed.HEADLINES_PER_SOURCE
# Request time of the registered headline selection. The API returns the last
# 24 hours; the test tables hold about six articles a day in total, so the
# registered query asks for two years, which makes the 100-per-source cap bite.
SELECTION_NOW = "1998-08-02 00:00:00"
SELECTION_HOURS = 24 * 731
# The 25 outlets of the test tables (nations, in key order) carry the names of the original's sources in turn; those
# past the list keep their own and are not requested.
N_SOURCES = len(fixed.HEADLINE_SOURCES)


def merged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = article_view(spark, sf_dir)
    hist = v.where(F.col("datetime") < HISTORY_BEFORE).select("url", "article_id", F.lit("history").alias("origin"))
    new = v.where(F.col("datetime") >= NEW_FROM).select("url", "article_id", F.lit("new").alias("origin"))
    # The stored articles are one row per URL (the output of earlier merges).
    return merge_history(hist, new, "url", order=["article_id"], history_unique=True) \
        .select("url", "article_id", "origin", "ingest_seq")


def leaning_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaning looked up by outlet from an outlet → leaning table (derived from ``nation``)."""
    dim = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"),
                                                leaning_of_nation("n_nationkey").alias("pol_leaning"))
    a = assign_leaning(article_view(spark, sf_dir).drop("pol_leaning"), dim)
    return a.where(F.col("source").isNotNull()).groupBy("source", "pol_leaning") \
        .agg(F.count("*").alias("n_articles"))


def _mentions(spark: SparkSession, sf_dir: str):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"),
                                                   F.col("l_partkey").alias("item_id"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"),
                                               F.concat("p_name", F.lit(" "), "p_brand").alias("entity"))
    return refs, names


def article_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, names = _mentions(spark, sf_dir)
    m = refs.join(names, "item_id")
    return m.groupBy("article_id", "entity").agg(F.count("*").alias("n_mentions"))


def topic_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, names = _mentions(spark, sf_dir)
    counts = ent.topic_entity_counts(article_view(spark, sf_dir), refs, names)
    return ent.top_entities(counts).select("topic", "rank", "entity", "n_mentions")


def related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, names = _mentions(spark, sf_dir)
    top = ent.top_entities(ent.topic_entity_counts(article_view(spark, sf_dir), refs, names))
    return ent.related_topics(top)


def article_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, names = _mentions(spark, sf_dir)
    v = article_view(spark, sf_dir)
    pairs = ent.related_topics(ent.top_entities(ent.topic_entity_counts(v, refs, names)))
    a = ent.attach_related(v.select("article_id", "topic"), pairs)
    closest = F.get("related_topics", 0)  # NULL for a topic without related ones, where [0] is an error
    return a.select("article_id", "topic", F.size("related_topics").alias("n_related"),
                    closest["topic"].alias("closest_topic"), closest["overlap"].alias("closest_overlap"))


def headline_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-shaped JSON responses built from the articles: one response per outlet and page of
    ``RESPONSE_PAGE`` article ids (so no response holds more than a page)."""
    v = article_view(spark, sf_dir)
    published = F.date_format(F.to_timestamp("datetime", "yyyyMMddHHmmss"), "yyyy-MM-dd HH:mm:ss")
    item = F.struct(F.col("topic").alias("title"), F.concat(F.lower("source"), F.lit(".de")).alias("clean_url"),
                    F.col("url").alias("link"), published.alias("published_date"),
                    F.col("sentiment").alias("summary"), F.lit(fixed.HEADLINE_LANGUAGE).alias("language"))
    page = F.floor(F.col("article_id") / F.lit(RESPONSE_PAGE))
    return v.groupBy("source", page.alias("page")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("body"))


def headline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_responses(headline_responses(spark, sf_dir), "body")
    return rows.select("title", "source", "url", "publishedAt",
                       dates.format_datetime("publishedAt").alias("datetime"), "description")


def headline_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request parameters applied to landed headlines: the listed sources, language, time window, and the
    newest ``HEADLINES_PER_SOURCE`` rows per outlet (ties: url)."""
    rows = parse_responses(headline_responses(spark, sf_dir), "body")
    names = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < N_SOURCES) \
        .select(F.concat(F.lower("n_name"), F.lit(".de")).alias("source"),
                F.element_at(F.array(*map(F.lit, fixed.HEADLINE_SOURCES)), F.col("n_nationkey").cast("int") + 1).alias("_name"))
    rows = rows.join(names, "source", "left").withColumn("source", F.coalesce("_name", "source")).drop("_name")
    sel = select_headlines(rows, now=SELECTION_NOW, sources=fixed.HEADLINE_SOURCES, hours=SELECTION_HOURS)
    return sel.select("title", "source", "url", "publishedAt", "language")


def daily_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = article_view(spark, sf_dir).withColumn("ts", article_ts("datetime"))
    w = coverage_windows(v, "ts", "1 day")
    return w.select(utc_day("window_start").alias("day"), "topic", "pol_leaning", "n_articles")


SPARK = {
    "merge_history": merged_articles,
    "leaning_by_source": leaning_by_source,
    "article_entity_counts": article_entity_counts,
    "topic_entities": topic_top_entities,
    "related_topics": related_topics,
    "article_related": article_related,
    "headline_rows": headline_rows,
    "headline_selection": headline_selection,
    "daily_coverage": daily_coverage,
}

_A = f"WITH {ARTICLE_VIEW_SQL}"
_TOP = f"""{_A},
m AS (SELECT a.topic, l_partkey FROM lineitem JOIN articles a ON l_orderkey = a.article_id WHERE a.topic IS NOT NULL),
c AS (SELECT topic, p_name || ' ' || p_brand AS entity, count(*) AS n_mentions
      FROM m JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n_mentions DESC, entity) AS rank FROM c),
top AS (SELECT topic, CAST(rank AS INTEGER) AS rank, entity, n_mentions FROM r WHERE rank <= {fixed.TOP_ENTITIES}),
pairs AS (SELECT a.topic, b.topic AS related_topic, count(*) AS overlap
          FROM top a JOIN top b ON a.entity = b.entity AND a.topic <> b.topic GROUP BY ALL)"""

ORACLE = {
    "merge_history": f"""{_A},
u AS (SELECT url, article_id, 'history' AS origin, 0 AS ingest_seq FROM articles WHERE datetime < '{HISTORY_BEFORE}'
      UNION ALL
      SELECT url, article_id, 'new', 1 FROM articles WHERE datetime >= '{NEW_FROM}')
SELECT url, article_id, origin, ingest_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY ingest_seq, article_id) AS rn FROM u) WHERE rn = 1""",

    "leaning_by_source": f"""{_A}
SELECT source, pol_leaning, count(*) AS n_articles FROM articles WHERE source IS NOT NULL GROUP BY ALL""",

    "article_entity_counts": """SELECT l_orderkey AS article_id, p_name || ' ' || p_brand AS entity, count(*) AS n_mentions
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",

    "topic_entities": f"""{_TOP}
SELECT topic, rank, entity, n_mentions FROM top""",

    "related_topics": f"""{_TOP}
SELECT topic, related_topic, overlap FROM pairs""",

    "article_related": f"""{_TOP},
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, related_topic) AS k,
                  count(*) OVER (PARTITION BY topic) AS n FROM pairs)
SELECT a.article_id, a.topic, CAST(coalesce(r.n, 0) AS INTEGER) AS n_related, r.related_topic AS closest_topic,
       r.overlap AS closest_overlap
FROM articles a LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON a.topic = r.topic""",

    "headline_rows": f"""{_A}
SELECT topic AS title, lower(source) || '.de' AS source, url,
       strftime(strptime(datetime, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS publishedAt, datetime,
       sentiment AS description
FROM articles""",

    "headline_selection": f"""{_A},
h AS (SELECT topic AS title, {S.str_list(fixed.HEADLINE_SOURCES)}[n_nationkey + 1] AS source, url,
             strftime(strptime(datetime, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS publishedAt,
             '{fixed.HEADLINE_LANGUAGE}' AS language, strptime(datetime, '%Y%m%d%H%M%S') AS ts
      FROM articles JOIN nation ON source = n_name WHERE n_nationkey < {N_SOURCES}),
w AS (SELECT * FROM h WHERE ts > TIMESTAMP '{SELECTION_NOW}' - INTERVAL {SELECTION_HOURS} HOUR
                        AND ts <= TIMESTAMP '{SELECTION_NOW}')
SELECT title, source, url, publishedAt, language FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, url) AS rn FROM w)
WHERE rn <= {fixed.HEADLINES_PER_SOURCE}""",

    "daily_coverage": f"""{_A}
SELECT CAST(date_trunc('day', strptime(datetime, '%Y%m%d%H%M%S')) AS DATE) AS day, topic, pol_leaning,
       count(*) AS n_articles
FROM articles WHERE topic IS NOT NULL GROUP BY ALL""",
}
