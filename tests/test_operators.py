"""Operator semantics on hand-made article rows."""

from datetime import date

from pyspark.sql import functions as F

from newslens.operators import coverage as cov
from newslens.operators import entities as ent
from newslens.operators import enrich, topics
from newslens.operators.cleaning import clean_articles
from newslens.operators.dedupe import keep_first, merge_history, only_new
from newslens.plans.enrichment import article_related

COLS = "article_id long, url string, topic string, source string, pol_leaning string, sentiment string, datetime string"


def arts(spark, rows):
    return spark.createDataFrame(rows, COLS)


def make(n, topic="T", leaning="links", sentiment="neutral", source="S", start=0, dt_="20240101000000"):
    return [(start + i, f"u{start + i}", topic, source, leaning, sentiment, dt_) for i in range(n)]


def test_blind_spot_boundaries(spark):
    # 10.00 % is a blind spot, 10.01 % is not, 0 % is "none"
    rows = make(1000, leaning="links") + make(9990, leaning="mitte", start=10000)
    rows = [(i, f"v{i}", "A", "S", "links" if i < 1000 else "mitte", "neutral", "20240101") for i in range(10000)]
    rows += [(20000 + i, f"w{i}", "B", "S", "links" if i < 1001 else "mitte", "neutral", "20240101")
             for i in range(10000)]
    got = {(r.topic, r.pol_leaning): (r.pct, r.status) for r in cov.blind_spots(arts(spark, rows)).collect()}
    assert got[("A", "links")] == (10.0, "low")
    assert ("B", "links") not in got
    assert got[("A", "rechts")] == (0.0, "none")
    assert got[("A", "mitte_rechts")] == (0.0, "none")


def test_leaning_share_without_known_leanings(spark):
    rows = [(1, "u1", "A", "S", "other", "neutral", "20240101")]
    got = cov.leaning_share(arts(spark, rows)).collect()
    assert len(got) == 5 and all(r.pct is None for r in got)
    assert cov.blind_spots(arts(spark, rows)).count() == 0


def test_topic_menu_threshold(spark):
    rows = make(49, topic="small") + make(50, topic="big", start=100)
    got = [(r.topic, r.n_articles) for r in cov.topic_menu(arts(spark, rows)).collect()]
    assert got == [("big", 50)]


def test_topic_menu_top_n_and_order(spark):
    rows = []
    for k, name in enumerate(["d", "c", "b", "a"]):
        rows += make(50 + k, topic=name, start=1000 * k)
    got = [r.topic for r in cov.topic_menu(arts(spark, rows), size=3).collect()]
    assert got == ["a", "b", "c"]


def test_one_point_regression(spark):
    rows = [(1, "u1", "A", "S", "links", "positive", "20240101"),
            (2, "u2", "B", "S", "links", "positive", "20240101"), (3, "u3", "B", "S", "links", "negative", "20240301")]
    got = {(r.topic, str(r.month)): r for r in cov.sentiment_trend(arts(spark, rows)).collect()}
    assert got[("A", "2024-01-01")].slope is None and got[("A", "2024-01-01")].intercept is None
    b = got[("B", "2024-03-01")]
    assert b.x_days == 60 and abs(b.slope - (-2 / 60)) < 1e-9 and abs(b.fitted - (-1.0)) < 1e-9


def test_sentiment_outside_domain(spark):
    rows = [(1, "u1", "A", "S", "links", "mixed", "20240101"), (2, "u2", "A", "S", "links", "positive", "20240101")]
    a = arts(spark, rows)
    totals = {r.sentiment: r.n_articles for r in cov.sentiment_totals(a).collect()}
    assert totals == {"negative": 0, "neutral": 0, "positive": 1}
    pct = {r.sentiment: r.pct for r in cov.sentiment_month_pct(a).collect()}
    assert pct == {"mixed": 50.0, "positive": 50.0}
    mean = cov.sentiment_score_month(a).first().mean_score
    assert mean == 1.0


def test_monthly_share_dense(spark):
    rows = [(1, "u1", "A", "X", "links", "neutral", "20240101"), (2, "u2", "A", "Y", "links", "neutral", "20240201"),
            (3, "u3", "A", "X", "links", "neutral", "20240201")]
    got = {(str(r.month), r.source): (r.n_articles, r.share) for r in cov.monthly_source_share(arts(spark, rows)).collect()}
    assert got == {("2024-01-01", "X"): (1, 0.5), ("2024-02-01", "X"): (1, 0.5),
                   ("2024-01-01", "Y"): (0, 0.0), ("2024-02-01", "Y"): (1, 1.0)}


def test_latest_article_per_leaning(spark):
    rows = [(1, "u1", "A", "S", "links", "neutral", "20240101"), (2, "u2", "A", "S", "links", "neutral", "20240301"),
            (3, "u3", "A", "S", "links", "neutral", "20240301"), (4, "u4", "A", "S", "mitte", "neutral", None)]
    got = {r.pol_leaning: r.url for r in cov.latest_articles(arts(spark, rows)).collect()}
    assert got == {"links": "u3", "mitte": "u4"}


def test_frequency_tables_and_stats(spark):
    rows = [(1, "u1", "A", "X", "links", "neutral", "20240101"), (2, "u2", None, "X", None, "neutral", "20240101"),
            (3, "u3", "B", "Y", "links", "neutral", "20240101")]
    a = arts(spark, rows)
    f = {(r.dimension, r.key): r.n_articles for r in cov.frequency_tables(a).collect()}
    assert f == {("all", None): 3, ("pol_leaning", "links"): 2, ("source", "X"): 2, ("source", "Y"): 1,
                 ("topic", "A"): 1, ("topic", "B"): 1}
    s = cov.dataset_stats(a).first()
    assert (s.n_articles, s.n_sources, s.n_topics, s.n_articles_text) == (3, 2, 2, "3")


def test_dedupe_history_wins_and_nulls_collapse(spark):
    hist = spark.createDataFrame([("a", "old", 1), (None, "h-null", 2)], "url string, v string, pos int")
    new = spark.createDataFrame([("a", "new", 1), ("b", "new", 2), (None, "n-null", 3), (None, "n-null2", 4)],
                                "url string, v string, pos int")
    got = {r.url: r.v for r in merge_history(hist, new, order=["pos"]).collect()}
    assert got == {"a": "old", "b": "new", None: "h-null"}
    once = keep_first(merge_history(hist, new, order=["pos"]), "url", ["ingest_seq", "pos"])
    assert sorted(once.collect(), key=str) == sorted(merge_history(hist, new, order=["pos"]).collect(), key=str)
    # A store that is already one row per key: the incremental path gives the same rows,
    # also for NULL keys in the store and in the batch.
    inc = merge_history(hist, new, order=["pos"], history_unique=True)
    assert sorted(inc.collect(), key=str) == sorted(merge_history(hist, new, order=["pos"]).collect(), key=str)
    no_null_store = hist.where("url IS NOT NULL")
    inc2 = merge_history(no_null_store, new, order=["pos"], history_unique=True)
    assert {r.url: r.v for r in inc2.collect()} == {"a": "old", "b": "new", None: "n-null"}


def test_only_new_both_paths(spark):
    stored = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    batch = spark.createDataFrame([("a", 1), ("c", 2), (None, 3), ("c", 4)], "url string, v int")
    for bound in (None, 10, 1):  # plain anti join, broadcast semi join, bound exceeded
        got = sorted(r.v for r in only_new(stored, batch, max_broadcast_rows=bound).collect())
        assert got == [2, 4], bound
    no_null = stored.where("url IS NOT NULL")
    assert sorted(r.v for r in only_new(no_null, batch, max_broadcast_rows=10).collect()) == [2, 3, 4]


def test_clean_articles_pipeline(spark):
    german = "Das ist ein Text und der Hund ist mit dem Ball im Garten"
    rows = [("t1", "x", "https://www.bild.de/a", "2024-11-06T12:34:56+01:00", "d", german + " http://x.y/z", 0, 1),
            ("t2", "x", "https://www.bild.de/a", "2024-11-07T00:00:00+01:00", "d", german, 1, 1),
            ("t3", "x", "https://www.unknown.de/b", "2024-11-06T00:00:00", "d", german, 0, 2),
            ("t4", "x", "https://www.taz.de/c", "2024-11-06T00:00:00", "d", "english only text here", 0, 3),
            ("t5", "x", "https://www.taz.de/d", "2024-11-06T00:00:00", None, german, 0, 4)]
    raw = spark.createDataFrame(rows, "title string, source string, url string, publishedAt string, "
                                      "description string, content string, ingest_seq int, pos int")
    out = clean_articles(raw, order=("ingest_seq", "pos")).collect()
    assert [(r.title, r.source, r.datetime, r.content) for r in out] == [("t1", "bild", "20241106123456", german + " ")]


def test_clean_articles_keeps_undated_rows(spark):
    german = "Das ist ein Text und der Hund ist mit dem Ball im Garten"
    rows = [("t1", "x", "https://www.bild.de/a", None, "d", german, 0),
            ("t2", "x", "https://www.bild.de/b", "2024-11-06T00:00:00", "d", german, 0)]
    raw = spark.createDataFrame(rows, "title string, source string, url string, publishedAt string, "
                                      "description string, content string, ingest_seq int")
    got = {r.title: r.datetime for r in clean_articles(raw).collect()}
    assert got == {"t1": None, "t2": "20241106000000"}


def test_leaning_lookup(spark):
    df = spark.createDataFrame([("bild",), ("taz",), ("nope",)], "source string")
    got = {r.source: r.pol_leaning for r in enrich.assign_leaning(df).collect()}
    assert got == {"bild": "rechts", "taz": "links", "nope": None}


def test_lexicon_and_hook(spark):
    df = spark.createDataFrame([(1, "Krieg und Krise"), (2, "ein guter Erfolg"), (3, "")], "id long, content string")
    t = enrich.lexicon_sentiment(enrich.with_tokens(df))
    got = {r.id: r.sentiment for r in t.collect()}
    assert got == {1: "negative", 2: "positive", 3: "neutral"}

    enrich.register_scorer("length", lambda s: s.str.len(), "long")
    scored = enrich.apply_scorer(df, "length", "content")
    assert {r.id: r.length for r in scored.collect()} == {1: 15, 2: 16, 3: 0}


def test_entity_count_map(spark):
    df = spark.createDataFrame([([("A", "PER"), ("A", "PER"), ("B", "LOC")],), (None,)],
                               "entities array<struct<text:string,label:string>>")
    got = [r[0] for r in df.select(ent.entity_count_map("entities")).collect()]
    assert got == [{"A": 2, "B": 1}, {}]


def test_entity_count_map_matches_counter_on_whole_documents(spark):
    """Brute force: Python's Counter over every document's entities, keys in first-seen order."""
    from collections import Counter

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") \
        .withColumn("entities", ent.capitalised_entities("text"))
    m = ent.entity_count_map("entities")
    rows = d.select("entities", m.alias("m"), F.map_keys(m).alias("k")).collect()
    for r in rows:
        expected = Counter(e["text"] for e in r.entities)
        assert r.m == dict(expected)
        assert r.k == list(expected)


def test_capitalised_entities(spark):
    df = spark.createDataFrame([("Olaf Scholz trifft die Presse in Berlin",)], "content string")
    got = df.select(ent.capitalised_entities("content", stop=["die"])).first()[0]
    assert [e["text"] for e in got] == ["Olaf Scholz", "Presse", "Berlin"]
    df = spark.createDataFrame([("Der Olaf Scholz, die SPD. Ein  Haus\nÖl-Preis x A Bund",)], "content string")
    got = df.select(ent.capitalised_entities("content", stop=["der", "ein"], gazetteer=ent.GAZETTEER)).first()[0]
    assert [(e["text"], e["label"]) for e in got] == [("Olaf Scholz", "PER"), ("SPD", "ORG"), ("Haus", "MISC"),
                                                      ("Öl", "MISC"), ("Preis", "MISC"), ("Bund", "MISC")]


def test_mentions_get_labels_from_a_table(spark):
    m = spark.createDataFrame([(1, "Berlin"), (2, "Olaf Scholz"), (3, "Nobody"), (4, None)], "id long, entity string")
    g = spark.createDataFrame([("BERLIN", "LOC"), ("berlin", "ORG"), ("olaf scholz", "PER"), (None, "X")], "name string, label string")
    got = {r.id: r.label for r in ent.label_mentions(m, g).collect()}
    assert got == {1: "LOC", 2: "PER", 3: "MISC", 4: "MISC"}


def test_lookup_is_broadcast_by_its_bytes(spark):
    from newslens.operators.joins import lookup_join, table_bytes

    df = spark.range(100).withColumn("k", F.col("id") % 10)
    dim = spark.range(10).select(F.col("id").alias("k"), F.expr("repeat('x', 1000)").alias("v"))
    assert 10_000 < table_bytes(dim) < 11_000 and table_bytes(dim, limit_rows=5) is None
    assert lookup_join(df, dim, "k").count() == lookup_join(df, dim, "k", max_bytes=10).count() == 100


def test_scorer_errors_are_per_row(spark):
    def fails_on_x(texts):
        if texts.str.contains("x").any():
            raise ValueError("no x")
        return texts.str.len()

    df = spark.createDataFrame([(1, "abc"), (2, "axb"), (3, "de")], "id long, content string")
    got = enrich.score_in_batches(df, fails_on_x, "content", "n", "long", error_col="error").orderBy("id").collect()
    assert [(r.n, r.error) for r in got] == [(3, None), (None, "ValueError: no x"), (2, None)]


def test_related_topics_symmetric_and_attached(spark):
    counts = spark.createDataFrame([("A", "x", 3), ("A", "y", 2), ("B", "x", 5), ("C", "z", 1)],
                                   "topic string, entity string, n_mentions long")
    pairs = ent.related_topics(ent.top_entities(counts, 10))
    got = {(r.topic, r.related_topic): r.overlap for r in pairs.collect()}
    assert got == {("A", "B"): 1, ("B", "A"): 1}
    a = spark.createDataFrame([(1, "A"), (2, "C")], "article_id long, topic string")
    rel = {r.article_id: r.related_topics for r in ent.attach_related(a, pairs).collect()}
    assert [(x.topic, x.overlap) for x in rel[1]] == [("B", 1)] and rel[2] == []


def test_topic_label_cutoff(spark):
    labels = topics.label_dim(spark, ["Alpha Beta", "Gamma"])
    reps = spark.createDataFrame([("t1", 1, "alpha"), ("t2", 1, "gamma delta"), ("t3", 1, "nothing")],
                                 "topic string, rank int, term string")
    got = {r.topic: (r.label, r.score) for r in topics.label_topics(reps, labels).collect()}
    # <alpha> has four 4-grams and <beta> three
    assert got == {"t1": ("Alpha Beta", round(4 / 7, 9)), "t2": ("Gamma", 1.0), "t3": ("None", 0.0)}
    strict = {r.topic: r.label for r in topics.label_topics(reps, labels, cutoff=0.6).collect()}
    assert strict["t1"] == "None"


def test_every_label_wins_on_its_own_text(spark):
    from newslens import fixed

    rows = []
    for label in fixed.DISTINCT_TOPIC_LABELS:
        words = label.replace("-", " ").split()
        # a compound longer than a token may be is written in two parts, as articles also do
        rows += [(label, i, p) for i, w in enumerate(words)
                 for p in ([w.lower()] if len(w) <= fixed.TOKEN_MAX_LEN else [w[:len(w) // 2].lower(), w[len(w) // 2:].lower()])]
    reps = spark.createDataFrame(rows, "topic string, rank int, term string")
    got = {r.topic: (r.label, r.score) for r in topics.label_topics(reps, topics.label_dim(spark)).collect()}
    assert len(got) == len(fixed.DISTINCT_TOPIC_LABELS)
    assert {t: lab for t, (lab, _) in got.items()} == {t: t for t in got}
    stray = spark.createDataFrame([("t", 1, "usa"), ("t", 2, "extreme")], "topic string, rank int, term string")
    assert topics.label_topics(stray, topics.label_dim(spark)).first().score < 1.0


def test_clusters_with_outliers(spark):
    pts = [(i, [0.0, 0.0]) for i in range(20)] + [(100 + i, [10.0, 10.0]) for i in range(20)] + [(999, [50.0, 50.0])]
    df = spark.createDataFrame(pts, "id long, embedding array<float>")
    got = topics.cluster_topics(df, k=3, min_size=10).collect()
    by_id = {r.id: r.topic_nr for r in got}
    assert by_id[999] == -1
    assert len({by_id[i] for i in range(20)}) == 1 and by_id[0] != by_id[100] and by_id[0] >= 0


def test_enrichment_run_columns_and_invariants(spark):
    from newslens import fixed
    from newslens.operators.cleaning import clean_content, drop_null_text
    from newslens.plans.daily_run import enrich_articles
    from newslens.sources.tables import ENRICHED_SCHEMA

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content")
    cleaned = drop_null_text(clean_content(d, "content"), "content")
    out = enrich_articles(cleaned, key="doc_id", k_topics=4, min_topic_size=3)
    wanted = {"pol_leaning", "processed_content", "processed_content_truncated", "sentiment", "topic_nr", "topic",
              "entities", "entity_counts", "related_topics"}
    assert wanted <= set(out.columns) and "tokens" not in out.columns
    assert out.schema["entity_counts"].dataType == ENRICHED_SCHEMA["entity_counts"].dataType
    rows = out.collect()
    assert len(rows) == cleaned.count()
    direct = {r.doc_id: r for r in enrich.with_tokens(cleaned).collect()}
    labels = set(fixed.DISTINCT_TOPIC_LABELS) | {"None"}
    for r in rows:
        assert r.processed_content == direct[r.doc_id].processed_content
        assert r.processed_content_truncated == direct[r.doc_id].processed_content_truncated
        assert r.sentiment in ("positive", "neutral", "negative") and r.topic in labels
        assert sum(r.entity_counts.values()) == len(r.entities)
        assert all(t.topic != r.topic and t.overlap >= 1 for t in r.related_topics)


def test_enrichment_with_supplied_vectors_for_some_rows(spark):
    from newslens.operators.cleaning import clean_content, drop_null_text
    from newslens.plans.daily_run import enrich_articles

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content")
    cleaned = drop_null_text(clean_content(d, "content"), "content")
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet") \
        .select(F.col("vec_id").alias("doc_id"), "embedding")
    with_vec = e.where(F.col("doc_id") % 2 == 0)
    out = enrich_articles(cleaned, key="doc_id", k_topics=4, min_topic_size=3, vectors=with_vec)
    rows = out.select("doc_id", "topic_nr").collect()
    assert len(rows) == cleaned.count()
    have = {r.doc_id for r in with_vec.collect()}
    assert all(r.topic_nr == -1 for r in rows if r.doc_id not in have)
    assert any(r.topic_nr >= 0 for r in rows if r.doc_id in have)


def test_enrichment_with_registered_sentiment_scorer(spark):
    from newslens.operators.cleaning import clean_content, drop_null_text
    from newslens.plans.daily_run import enrich_articles

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content")
    cleaned = drop_null_text(clean_content(d, "content"), "content")
    # A stand-in model: long truncated texts are "positive", others "negative".
    enrich.register_scorer("by_length", lambda s: s.str.len().gt(2000).map({True: "positive", False: "negative"}))
    out = enrich_articles(cleaned, key="doc_id", k_topics=4, min_topic_size=3, scorer="by_length")
    rows = out.select("sentiment", "processed_content_truncated").collect()
    assert len(rows) == cleaned.count()
    assert all(r.sentiment == ("positive" if len(r.processed_content_truncated) > 2000 else "negative") for r in rows)


def test_enrichment_of_an_empty_batch(spark):
    from newslens.operators.cleaning import clean_content, drop_null_text
    from newslens.plans.daily_run import enrich_articles

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content") \
        .where(F.col("doc_id") < 0)
    out = enrich_articles(drop_null_text(clean_content(d, "content"), "content"), key="doc_id", k_topics=4)
    assert out.count() == 0
    assert {"topic_nr", "topic", "entities", "entity_counts", "related_topics", "processed_content"} <= set(out.columns)


def test_articles_of_a_topic_without_related_ones(spark, tmpdir_run):
    """Customers 1 and 2 (T01) share a part with customer 9 (T03); nobody shares the one of customer 100 (T10)."""
    rows = {"nation": ("n_nationkey int, n_name string", [(0, "A")]),
            "customer": ("c_custkey long, c_nationkey int", [(1, 0), (2, 0), (9, 0), (100, 0)]),
            "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date",
                       [(k, c, "F", date(1995, 1, 1)) for k, c in ((1, 1), (2, 2), (3, 9), (4, 100))]),
            "lineitem": ("l_orderkey long, l_partkey long", [(1, 7), (2, 7), (3, 7), (4, 8)]),
            "part": ("p_partkey long, p_name string, p_brand string", [(7, "x", "b"), (8, "y", "b")])}
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmpdir_run}/{name}.parquet")
    got = sorted(tuple(r) for r in article_related(spark, tmpdir_run).collect())
    assert got == [(1, "T01", 1, "T03", 1), (2, "T01", 1, "T03", 1), (3, "T03", 1, "T01", 1), (4, "T10", 0, None, None)]
