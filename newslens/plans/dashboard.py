"""Registered dashboard queries over the article view of the test tables (Spark side + SQL oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newslens import fixed
from newslens.operators import coverage as cov
from newslens.sources.articles import ARTICLE_VIEW_SQL, article_view, prepare_for_dashboard

# Month floor used by the registered month-filter query: the test tables span
# 1995-01 … 2001-08, so the dashboard's own floor (2023-11) would keep nothing.
TEST_MONTH_FLOOR = 199701
# Month range of the registered range query (first and last month, both included).
RANGE_START, RANGE_END = "1996-03-01", "1997-06-01"


def dashboard_articles(spark: SparkSession, sf_dir: str, month_floor: int | None = None) -> DataFrame:
    return prepare_for_dashboard(article_view(spark, sf_dir), month_floor=month_floor,
                                 excluded_topic=fixed.EXCLUDED_TOPIC)


def _q(fn):
    return lambda spark, sf_dir: fn(dashboard_articles(spark, sf_dir))


SPARK = {
    "topic_menu": _q(cov.topic_menu),
    "leaning_counts": _q(cov.leaning_counts),
    "leaning_share": _q(cov.leaning_share),
    "blind_spots": _q(cov.blind_spots),
    "latest_articles": _q(cov.latest_articles),
    "month_bounds": _q(cov.month_bounds),
    "monthly_source_share": _q(cov.monthly_source_share),
    "monthly_source_share_range": _q(lambda a: cov.monthly_source_share(a, RANGE_START, RANGE_END)),
    "sentiment_score_month_range": _q(lambda a: cov.sentiment_score_month(a, start=RANGE_START, end=RANGE_END)),
    "sentiment_totals": _q(cov.sentiment_totals),
    "sentiment_by_source": _q(cov.sentiment_by_source),
    "sentiment_month_pct": _q(cov.sentiment_month_pct),
    "sentiment_score_month": _q(cov.sentiment_score_month),
    "sentiment_trend": _q(cov.sentiment_trend),
    "source_leanings": _q(cov.source_leanings),
    "frequency_tables": _q(cov.frequency_tables),
    "dataset_stats": _q(cov.dataset_stats),
    "month_floor_filter": lambda spark, sf_dir: dashboard_articles(spark, sf_dir, TEST_MONTH_FLOOR)
    .select("article_id", "topic", "datetime"),
}


def _lit_rows(col: str, values) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + f") AS d(domain_pos, {col})"


_DASH = f"""WITH {ARTICLE_VIEW_SQL},
dash AS (SELECT * FROM articles WHERE topic IS DISTINCT FROM '{fixed.EXCLUDED_TOPIC}'),
monthly AS (
  SELECT * FROM (SELECT *, CAST(try_strptime(substr(datetime, 1, 6), '%Y%m') AS DATE) AS month
                 FROM dash WHERE regexp_matches(datetime, '^\\p{{Nd}}{{8,}}'))
  WHERE month IS NOT NULL)"""

def _ranged(sql: str) -> str:
    """The same query over the months of the range."""
    return sql.replace("WHERE month IS NOT NULL)", f"WHERE month BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}')", 1)


_LEANING_SHARE = f"""{_DASH},
t AS (SELECT DISTINCT topic FROM dash WHERE topic IS NOT NULL),
c AS (SELECT topic, pol_leaning, count(*) AS n FROM dash WHERE topic IS NOT NULL GROUP BY ALL),
s AS (
  SELECT t.topic, d.pol_leaning, coalesce(c.n, 0) AS n_articles,
         round_even(CAST(coalesce(c.n, 0) AS DOUBLE)
                    / NULLIF(CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY t.topic) AS DOUBLE), 0)
                    * 100.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pct
  FROM t CROSS JOIN {_lit_rows('pol_leaning', fixed.LEANINGS)}
  LEFT JOIN c ON c.topic = t.topic AND c.pol_leaning = d.pol_leaning)"""

_SCORE_MONTH = f"""{_DASH},
sm AS (
  SELECT topic, month, pol_leaning,
         avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 WHEN 'negative' THEN -1 END) AS mean_score
  FROM monthly WHERE topic IS NOT NULL AND pol_leaning IN ('links', 'mitte', 'rechts')
  GROUP BY ALL)"""


def _r9(expr: str) -> str:
    return f"round_even(({expr}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE"


ORACLE = {
    "topic_menu": f"""{_DASH},
c AS (SELECT topic, count(*) AS n_articles FROM dash WHERE topic IS NOT NULL GROUP BY topic)
SELECT topic, n_articles FROM (
  SELECT * FROM c WHERE n_articles >= {fixed.MIN_TOPIC_ARTICLES}
  ORDER BY n_articles DESC, topic LIMIT {fixed.TOPIC_MENU_SIZE}) ORDER BY topic""",

    "leaning_counts": f"""{_DASH},
c AS (SELECT topic, pol_leaning, count(*) AS n_articles FROM dash
      WHERE topic IS NOT NULL AND pol_leaning IS NOT NULL GROUP BY ALL)
SELECT topic, pol_leaning, n_articles,
       CAST(n_articles AS DOUBLE) / CAST(sum(n_articles) OVER (PARTITION BY topic) AS DOUBLE) AS share
FROM c""",

    "leaning_share": f"""{_LEANING_SHARE}
SELECT topic, pol_leaning, n_articles, pct FROM s""",

    "blind_spots": f"""{_LEANING_SHARE}
SELECT topic, pol_leaning, pct, CASE WHEN pct = 0 THEN 'none' ELSE 'low' END AS status
FROM s WHERE pct <= {fixed.BLIND_SPOT_PCT}""",

    "latest_articles": f"""{_DASH}
SELECT topic, pol_leaning, datetime, url, article_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, pol_leaning ORDER BY datetime DESC NULLS LAST, url DESC) AS rn
  FROM dash WHERE topic IS NOT NULL AND pol_leaning IS NOT NULL) WHERE rn = 1""",

    "month_bounds": f"""{_DASH}
SELECT min(month) AS first_month, max(month) AS last_month, count(*) AS n_articles,
       strftime(min(month), '%m/%Y') AS first_label, strftime(max(month), '%m/%Y') AS last_label
FROM monthly""",

    "monthly_source_share": f"""{_DASH},
c AS (SELECT topic, month, source, count(*) AS n FROM monthly
      WHERE topic IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
g AS (SELECT a.topic, a.month, b.source
      FROM (SELECT DISTINCT topic, month FROM c) a JOIN (SELECT DISTINCT topic, source FROM c) b USING (topic))
SELECT g.topic, g.month, g.source, coalesce(c.n, 0) AS n_articles,
       CAST(coalesce(c.n, 0) AS DOUBLE)
       / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.topic, g.source) AS DOUBLE) AS share
FROM g LEFT JOIN c USING (topic, month, source)""",

    "sentiment_totals": f"""{_DASH},
t AS (SELECT DISTINCT topic FROM dash WHERE topic IS NOT NULL),
c AS (SELECT topic, sentiment, count(*) AS n FROM dash WHERE topic IS NOT NULL GROUP BY ALL)
SELECT t.topic, d.sentiment, coalesce(c.n, 0) AS n_articles
FROM t CROSS JOIN {_lit_rows('sentiment', fixed.SENTIMENTS)}
LEFT JOIN c ON c.topic = t.topic AND c.sentiment = d.sentiment""",

    "sentiment_by_source": f"""{_DASH}
SELECT topic, source,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive
FROM dash WHERE topic IS NOT NULL AND source IS NOT NULL AND sentiment IS NOT NULL GROUP BY topic, source""",

    "sentiment_month_pct": f"""{_DASH},
c AS (SELECT topic, month, sentiment, count(*) AS n FROM monthly
      WHERE topic IS NOT NULL AND sentiment IS NOT NULL GROUP BY ALL),
g AS (SELECT a.topic, a.month, b.sentiment
      FROM (SELECT DISTINCT topic, month FROM c) a JOIN (SELECT DISTINCT topic, sentiment FROM c) b USING (topic))
SELECT g.topic, g.month, g.sentiment, coalesce(c.n, 0) AS n_articles,
       CAST(coalesce(c.n, 0) AS DOUBLE)
       / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.topic, g.month) AS DOUBLE) * 100.0::DOUBLE AS pct
FROM g LEFT JOIN c USING (topic, month, sentiment)""",

    "sentiment_score_month": f"""{_SCORE_MONTH}
SELECT topic, month, pol_leaning, mean_score FROM sm""",

    "sentiment_trend": f"""{_SCORE_MONTH},
p AS (SELECT *, CAST(date_diff('day', min(month) OVER (PARTITION BY topic, pol_leaning), month) AS INTEGER) AS x_days
      FROM sm),
f AS (SELECT *, regr_slope(mean_score, x_days) OVER w AS slope, regr_intercept(mean_score, x_days) OVER w AS intercept,
             regr_count(mean_score, x_days) OVER w AS n_points
      FROM p WINDOW w AS (PARTITION BY topic, pol_leaning)),
e AS (SELECT topic, pol_leaning, month, x_days, mean_score,
             CASE WHEN n_points >= 2 THEN slope END AS slope, CASE WHEN n_points >= 2 THEN intercept END AS intercept
      FROM f)
SELECT topic, pol_leaning, month, x_days, mean_score, {_r9('slope')} AS slope, {_r9('intercept')} AS intercept,
       {_r9('slope * x_days + intercept')} AS fitted
FROM e""",

    "source_leanings": f"""{_DASH}
SELECT DISTINCT source, pol_leaning FROM dash ORDER BY pol_leaning, source""",

    "frequency_tables": f"""{_DASH}
SELECT 'pol_leaning' AS dimension, pol_leaning AS key, count(*) AS n_articles FROM dash WHERE pol_leaning IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM dash WHERE source IS NOT NULL GROUP BY 2
UNION ALL SELECT 'topic', topic, count(*) FROM dash WHERE topic IS NOT NULL GROUP BY 2
UNION ALL SELECT 'all', NULL, count(*) FROM dash""",

    "dataset_stats": f"""{_DASH}
SELECT count(*) AS n_articles, count(DISTINCT source) AS n_sources, count(DISTINCT topic) AS n_topics,
       format('{{:,}}', count(*)) AS n_articles_text
FROM dash""",

    "month_floor_filter": f"""{_DASH}
SELECT article_id, topic, datetime FROM dash
WHERE datetime IS NULL OR substr(datetime, 1, 6) = 'nan'
   OR (regexp_matches(substr(datetime, 1, 6), '^[0-9]+$')
       AND TRY_CAST(substr(datetime, 1, 6) AS INTEGER) >= {TEST_MONTH_FLOOR})""",
}

ORACLE["monthly_source_share_range"] = _ranged(ORACLE["monthly_source_share"])
ORACLE["sentiment_score_month_range"] = _ranged(ORACLE["sentiment_score_month"])
