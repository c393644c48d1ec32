"""Media-coverage queries over the article table, for all topics at once.

Input columns: ``topic, source, pol_leaning, sentiment, datetime, url`` (plus
any others). Every query first aggregates with map-side partial aggregation,
so a topic holding a third of all rows costs one row per task in the shuffle;
everything after the first aggregate runs on rows bounded by
topics × months × outlets × labels, not by articles.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import dates
from newslens.functions.scores import round_half_even, sentiment_score, share
from newslens.session import cut_lineage


def _known(*cols: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def _domain_counts(df: DataFrame, keys: Sequence[str], col: str, domain: Sequence[str],
                   count_name: str) -> DataFrame:
    """Counts of ``col`` over a fixed value domain per group, long form, zeros included.

    One conditional aggregate per domain value (no join against the domain):
    the result has exactly ``len(domain)`` rows per group, in domain order
    given by ``domain_pos``.
    """
    agg = df.groupBy(*keys).agg(*[F.count_if(F.col(col) == v).alias(f"_n{i}") for i, v in enumerate(domain)])
    cells = F.array(*[F.struct(F.lit(v).alias(col), F.col(f"_n{i}").alias(count_name),
                               F.lit(i).alias("domain_pos")) for i, v in enumerate(domain)])
    return agg.select(*keys, F.inline(cells))


# --- topic menu and leaning shares -------------------------------------------------


def topic_menu(df: DataFrame, min_articles: int = fixed.MIN_TOPIC_ARTICLES,
               size: int = fixed.TOPIC_MENU_SIZE) -> DataFrame:
    """Topics with at least ``min_articles`` articles; the ``size`` largest (ties: name), by name."""
    counts = df.where(_known("topic")).groupBy("topic").agg(F.count("*").alias("n_articles"))
    top = counts.where(F.col("n_articles") >= min_articles) \
        .orderBy(F.desc("n_articles"), F.asc("topic")).limit(size)
    return top.orderBy("topic")


def leaning_counts(df: DataFrame) -> DataFrame:
    """Articles per topic and leaning (leanings without articles absent) and the pie share, most articles first."""
    counts = df.where(_known("topic", "pol_leaning")).groupBy("topic", "pol_leaning") \
        .agg(F.count("*").alias("n_articles"))
    total = F.sum("n_articles").over(Window.partitionBy("topic"))
    return counts.withColumn("share", share(F.col("n_articles"), total)) \
        .orderBy("topic", F.desc("n_articles"), "pol_leaning")


def leaning_share(df: DataFrame, leanings: Sequence[str] = fixed.LEANINGS) -> DataFrame:
    """Share in percent (2 places, half-even) of each of the known leanings per topic.

    The denominator is the articles of the known leanings only; a topic
    without any gets NULL shares.
    """
    long = _domain_counts(df.where(_known("topic")), ["topic"], "pol_leaning", leanings, "n_articles")
    total = F.sum("n_articles").over(Window.partitionBy("topic"))
    pct = round_half_even(share(F.col("n_articles"), total) * F.lit(100.0), 2)
    return long.withColumn("pct", pct).drop("domain_pos")


def blind_spots(df: DataFrame, leanings: Sequence[str] = fixed.LEANINGS,
                max_pct: float = fixed.BLIND_SPOT_PCT) -> DataFrame:
    """Leanings that cover a topic at most ``max_pct`` percent: ``none`` at 0 %, else ``low``."""
    s = leaning_share(df, leanings).where(F.col("pct") <= F.lit(float(max_pct)))
    return s.select("topic", "pol_leaning", "pct",
                    F.when(F.col("pct") == 0.0, "none").otherwise("low").alias("status"))


def latest_articles(df: DataFrame) -> DataFrame:
    """Most recent article per topic and leaning (ties → larger ``datetime`` text, then larger url).

    The date's digits, padded to seconds, are compared as a number: that ``max`` is a hash aggregate with a partial
    step, so no task sorts its rows. Its table (a row per topic and leaning) is joined back, and only the rows with the
    latest date are compared as text. A date that is no such number ranks below all others.
    """
    digits = F.col("datetime").rlike("^[0-9]{8,14}$")
    stamp = F.coalesce(F.when(digits, F.rpad("datetime", 14, "0").try_cast("bigint")), F.lit(-1))
    known = df.where(_known("topic", "pol_leaning")).withColumn("_stamp", stamp)
    last = known.groupBy("topic", "pol_leaning").agg(F.max("_stamp").alias("_stamp"))
    best = F.max(F.struct("datetime", "url", "article_id", "source"))
    g = known.join(last, ["topic", "pol_leaning", "_stamp"]).groupBy("topic", "pol_leaning").agg(best.alias("m"))
    return g.select("topic", "pol_leaning", "m.datetime", "m.url", "m.article_id", "m.source")


# --- time series -------------------------------------------------------------------


def with_month(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with at least 8 leading date digits, their month, optionally within [start, end]."""
    m = df.where(dates.has_digit_date("datetime")).withColumn("month", dates.month_of("datetime")) \
        .where(F.col("month").isNotNull())
    if start is not None:
        m = m.where(F.col("month") >= F.to_date(F.lit(str(start))))
    if end is not None:
        m = m.where(F.col("month") <= F.to_date(F.lit(str(end))))
    return m


def month_bounds(df: DataFrame) -> DataFrame:
    """First and last month present (the range the time-series views start from)."""
    m = with_month(df)
    b = m.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"),
              F.count("*").alias("n_articles"))
    return b.withColumn("first_label", dates.month_label("first_month")) \
        .withColumn("last_label", dates.month_label("last_month"))


def _dense_grid(counts: DataFrame, group: str, row_key: str, col_key: str, value: str) -> DataFrame:
    """Complete ``row_key × col_key`` grid per ``group`` with zero fill.

    Only keys observed in the group form the grid. The column keys of a group
    are a set of outlet or label values (bounded by that dimension, not by the
    article count), so they are gathered into one array per group and exploded
    against the group's observed rows. ``counts`` feeds three branches; it is
    small (one row per cell) and written to the checkpoint folder once, so the
    article table is scanned once.
    """
    counts = cut_lineage(counts)
    cols = counts.groupBy(group).agg(F.collect_set(col_key).alias("_keys"))
    rows = counts.select(group, row_key).distinct()
    grid = rows.join(cols, group).select(group, row_key, F.explode("_keys").alias(col_key))
    return grid.join(counts, [group, row_key, col_key], "left").fillna(0, [value])


def monthly_source_share(df: DataFrame, start=None, end=None) -> DataFrame:
    """Per topic: each outlet's articles per month divided by the outlet's articles on the
    topic in the range; every observed month × outlet of the topic, missing cells 0."""
    m = with_month(df, start, end).where(_known("topic", "source"))
    counts = m.groupBy("topic", "month", "source").agg(F.count("*").alias("n_articles"))
    dense = _dense_grid(counts, "topic", "month", "source", "n_articles")
    total = F.sum("n_articles").over(Window.partitionBy("topic", "source"))
    return dense.withColumn("share", share(F.col("n_articles"), total))


def sentiment_month_pct(df: DataFrame, start=None, end=None) -> DataFrame:
    """Per topic and month: percentage of each sentiment label observed on the topic.

    Labels outside the three known ones count in the denominator like the others.
    """
    m = with_month(df, start, end).where(_known("topic", "sentiment"))
    counts = m.groupBy("topic", "month", "sentiment").agg(F.count("*").alias("n_articles"))
    dense = _dense_grid(counts, "topic", "month", "sentiment", "n_articles")
    total = F.sum("n_articles").over(Window.partitionBy("topic", "month"))
    return dense.withColumn("pct", share(F.col("n_articles"), total) * F.lit(100.0))


def sentiment_score_month(df: DataFrame, leanings: Sequence[str] = fixed.TREND_LEANINGS,
                          start=None, end=None) -> DataFrame:
    """Mean sentiment score (+1/0/-1, other labels skipped) per topic, month and leaning."""
    m = with_month(df, start, end).where(_known("topic") & F.col("pol_leaning").isin(*leanings))
    return m.groupBy("topic", "month", "pol_leaning") \
        .agg(F.avg(sentiment_score("sentiment")).alias("mean_score"))


def sentiment_trend(df: DataFrame, leanings: Sequence[str] = fixed.TREND_LEANINGS,
                    start=None, end=None, digits: int = 9) -> DataFrame:
    """Least-squares line of the monthly mean score per topic and leaning.

    x = days since the group's first month. Fewer than two points give NULL
    slope and intercept (and NULL fitted values).
    """
    pts = sentiment_score_month(df, leanings, start, end)
    w = Window.partitionBy("topic", "pol_leaning")
    pts = pts.withColumn("x_days", F.datediff("month", F.min("month").over(w)))
    fit = pts.withColumn("slope", F.regr_slope("mean_score", "x_days").over(w)) \
        .withColumn("intercept", F.regr_intercept("mean_score", "x_days").over(w)) \
        .withColumn("n_points", F.regr_count("mean_score", "x_days").over(w))
    enough = F.col("n_points") >= 2
    slope = F.when(enough, F.col("slope"))
    intercept = F.when(enough, F.col("intercept"))
    fitted = slope * F.col("x_days") + intercept
    return fit.select("topic", "pol_leaning", "month", "x_days", "mean_score",
                      round_half_even(slope, digits).alias("slope"),
                      round_half_even(intercept, digits).alias("intercept"),
                      round_half_even(fitted, digits).alias("fitted"))


# --- sentiment mix -------------------------------------------------------------------


def sentiment_totals(df: DataFrame, labels: Sequence[str] = fixed.SENTIMENTS) -> DataFrame:
    """Articles per topic and sentiment label over the three known labels, zeros included."""
    return _domain_counts(df.where(_known("topic")), ["topic"], "sentiment", labels, "n_articles") \
        .drop("domain_pos")


def sentiment_by_source(df: DataFrame, labels: Sequence[str] = fixed.SENTIMENTS) -> DataFrame:
    """Wide table: per topic and outlet one count column per known label."""
    t = df.where(_known("topic", "source", "sentiment"))
    return t.groupBy("topic", "source").agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in labels])


# --- about page --------------------------------------------------------------------


def source_leanings(df: DataFrame) -> DataFrame:
    """Distinct outlet–leaning pairs, ordered by leaning."""
    return df.select("source", "pol_leaning").distinct().orderBy("pol_leaning", "source")


def frequencies(df: DataFrame) -> DataFrame:
    """Article counts by leaning, by outlet and by topic, plus the total, in one pass.

    ``dimension`` is ``pol_leaning``, ``source``, ``topic`` or ``all``; NULL keys are dropped.
    """
    g = df.groupingSets([["pol_leaning"], ["source"], ["topic"], []], "pol_leaning", "source", "topic") \
        .agg(F.count("*").alias("n_articles"), F.grouping_id().alias("_gid"))
    dim = (F.when(F.col("_gid") == 3, "pol_leaning").when(F.col("_gid") == 5, "source")
           .when(F.col("_gid") == 6, "topic").otherwise("all"))
    out = g.select(dim.alias("dimension"), F.coalesce("pol_leaning", "source", "topic").alias("key"),
                   "n_articles")
    return out.where((F.col("dimension") == "all") | F.col("key").isNotNull())


def frequency_tables(df: DataFrame) -> DataFrame:
    """`frequencies` in order: each table has its most frequent keys first (ties: key)."""
    return frequencies(df).orderBy("dimension", F.desc("n_articles"), "key")


def dataset_stats(df: DataFrame) -> DataFrame:
    """Articles, distinct outlets, distinct topics (and the count with thousands separators)."""
    f = frequencies(df)
    s = f.agg(F.sum(F.when(F.col("dimension") == "all", F.col("n_articles"))).alias("n_articles"),
              F.count_if(F.col("dimension") == "source").alias("n_sources"),
              F.count_if(F.col("dimension") == "topic").alias("n_topics"))
    return s.withColumn("n_articles_text", F.format_number("n_articles", 0))
