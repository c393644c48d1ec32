"""What the enrichment run stores: packed article rows, and vectors on disk while k-means runs."""

from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from newslens.functions.scores import spark_stopwords
from newslens.operators import enrich, entities as ent
from newslens.plans import daily_run

TEXTS = ["Anna Berg trifft Olaf Scholz in Berlin", "haushalt und steuern und haushalt", "Der Krieg. Die Krise", "1 2 3", "und"]


def _articles(spark, copies=6):
    rows = [(i, TEXTS[i % len(TEXTS)], i % 2) for i in range(copies * len(TEXTS))]
    return spark.createDataFrame(rows, "url long, content string, n int").repartition(3, "url")


def test_kmeans_reads_its_vectors_from_disk(spark, monkeypatch):
    levels, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *a: levels.append(df.storageLevel) or fit(self, df, *a))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = daily_run.enrich_articles(_articles(spark), k_topics=2, min_topic_size=1)
    assert [(x.useDisk, x.useMemory) for x in levels] == [(True, False)]  # not as objects on the heaps
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held  # and they are given back
    per_text = out.groupBy("content").agg(F.count("*").alias("n"), F.count_distinct("topic_nr").alias("topics")).collect()
    assert len(per_text) == len(TEXTS) and all(r.n == 6 and r.topics == 1 for r in per_text)


def test_stored_rows_are_packed_and_hold_no_unwanted_text(spark, monkeypatch):
    kept, cut = [], daily_run.cut_lineage
    monkeypatch.setattr(daily_run, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    daily_run.enrich_articles(_articles(spark), class_col="n", keep_text=False)
    assert "content" not in kept[0].columns and not any(t.startswith("array") for _, t in kept[0].dtypes)


def test_packed_rows_come_back_as_they_were(spark):
    stop = spark_stopwords("german")
    a = _articles(spark)
    named = ent.capitalised_entities("content", stop=stop, gazetteer=ent.GAZETTEER)
    want = enrich.with_tokens(a, "content", stop).withColumn("entities", named)
    out = daily_run.enrich_articles(a, class_col="n", keep_text=False)
    assert set(want.columns) - set(out.columns) == {"content", "tokens"}
    cols = ["url", "entities", "processed_content", "processed_content_truncated"]
    got = sorted(map(tuple, out.select(*cols).collect()))
    assert got == sorted(map(tuple, want.select(*cols).collect()))
    assert {len(r[1]) for r in got} > {0} and {r[2] for r in got} > {""}
