"""Physical-plan shape of the operators that meet hot keys (one key may hold a third of all rows)."""

import re

from pyspark.sql import functions as F

from newslens.operators import coverage as cov
from newslens.operators import entities as ent
from newslens.operators.dedupe import keep_first
from newslens.sources.headlines import select_headlines


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed_articles(spark, n=3000):
    # Topic "HOT", outlet "S0" and one URL each hold a third of the rows.
    rows = [(i, "dup" if i % 3 == 0 else f"u{i}", "HOT" if i % 3 == 0 else f"T{i % 7}",
             "S0" if i % 3 == 0 else f"S{i % 5}", "links" if i % 2 else "mitte", "neutral",
             f"2024{1 + i % 12:02d}01{i % 24:02d}0000") for i in range(n)]
    return spark.createDataFrame(rows, "article_id long, url string, topic string, source string, "
                                       "pol_leaning string, sentiment string, datetime string")


def _no_bad_joins(plan: str):
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan


def test_latest_article_is_a_partial_aggregate(spark):
    a = _skewed_articles(spark)
    df = cov.latest_articles(a)
    plan = _plan(df)
    # The raw rows meet a hash aggregate of a number only; the sort aggregate of structs is behind the join.
    assert "Window" not in plan and re.search(r"HashAggregate\(.*partial_max\(_stamp", plan)
    _no_bad_joins(plan)
    best = {(r.topic, r.pol_leaning): r.datetime for r in df.collect()}
    exp = {(r.topic, r.pol_leaning): r.m for r in a.groupBy("topic", "pol_leaning").agg(F.max("datetime").alias("m"))
           .collect()}
    assert best == exp


def test_keep_first_is_a_partial_aggregate(spark):
    a = _skewed_articles(spark)
    df = keep_first(a, "url", ["article_id"])
    plan = _plan(df)
    assert "Window" not in plan and "partial_min_by" in plan
    got = {r.url: r.article_id for r in df.collect()}
    assert got["dup"] == 0 and len(got) == a.select("url").distinct().count()


def test_top_k_limits_each_task_before_the_shuffle(spark):
    a = _skewed_articles(spark)
    counts = a.groupBy("topic", F.col("url").alias("entity")).agg(F.count("*").alias("n_mentions"))
    top = ent.top_entities(counts, 3)
    plan = _plan(top)
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)
    assert top.where("topic = 'HOT'").count() == 1  # HOT has one distinct "entity"
    heads = a.select(F.col("topic").alias("title"), "source", "url",
                     F.concat_ws(" ", F.substring("datetime", 1, 8), F.lit("00:00:00")).alias("p"),
                     F.lit("de").alias("language"))
    heads = heads.withColumn("publishedAt", F.date_format(F.to_timestamp("p", "yyyyMMdd HH:mm:ss"),
                                                          "yyyy-MM-dd HH:mm:ss")).drop("p")
    sel = select_headlines(heads, now="2025-01-01 00:00:00", hours=24 * 400, per_source=100)
    plan = _plan(sel)
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    per_source = {r.source: r.n for r in sel.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert per_source["S0"] == 100


def test_related_topics_is_an_equi_join(spark):
    counts = spark.createDataFrame([(f"T{t}", f"e{(t + j) % 15}", 10 - j) for t in range(12) for j in range(10)],
                                   "topic string, entity string, n_mentions long")
    pairs = ent.related_topics(ent.top_entities(counts))
    plan = _plan(pairs)
    _no_bad_joins(plan)
    rows = {(r.topic, r.related_topic): r.overlap for r in pairs.collect()}
    assert all(rows[(b, a)] == n for (a, b), n in rows.items()) and all(1 <= n <= 10 for n in rows.values())


def test_spread_only_when_the_caller_asks(spark):
    from newslens.sources.tables import SPREAD_CONF, spread

    few = spark.range(0, 1000, numPartitions=1)
    assert spread(few, "id") is few
    spark.conf.set(SPREAD_CONF, "6")
    try:
        wide = spread(few, "id")
        assert "Exchange hashpartitioning(id" in _plan(wide) and wide.rdd.getNumPartitions() == 6
        assert sorted(r.id for r in wide.collect()) == list(range(1000))
    finally:
        spark.conf.unset(SPREAD_CONF)


def test_texts_are_tokenised_once_for_topic_terms(spark):
    from newslens.operators import topics

    d = spark.createDataFrame([(f"s{i % 3}", [f"w{i % 7}", f"v{i}"]) for i in range(60)], "c string, tokens array<string>")
    plan = _plan(topics.class_tfidf(d, "c"))
    assert "Generate" not in plan  # the term counts come from the checkpoint
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
