"""The daily enrichment run as one composition of library operators.

cleaned articles → leaning → tokens → sentiment → topic clusters → topic
representation and label → entities and entity counts → related topics.
Every step is a DataFrame transformation; the only jobs started while the
plan is being built are the k-means fit, the IDF fit and the checkpoints of
small shared tables.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions.scores import spark_stopwords
from newslens.operators import enrich, entities as ent, topics
from newslens.operators.cleaning import clean_content, drop_null_text
from newslens.operators.joins import lookup_join
from newslens.plans import sqltext as S, texts
from newslens.session import cut_lineage, free_unused
from newslens.sources.tables import spread, table


def _pack(df: DataFrame) -> DataFrame:
    """``tokens`` and ``_entities`` as text: a checkpoint writes rows as they lie in memory, where an array takes 16 bytes
    and more for every word of it. Tokens hold no blank, names and labels no line break, and none of them is empty."""
    names = F.col("_entities")
    return df.withColumns({"tokens": F.array_join("tokens", " "), "_names": F.array_join(names["text"], "\n"),
                           "_labels": F.array_join(names["label"], "\n")}).drop("_entities")


def _words(packed: str, mark: str) -> Column:
    return F.when(F.col(packed) == "", F.array().cast("array<string>")).otherwise(F.split(packed, mark))


def _unpack(df: DataFrame) -> DataFrame:
    entity = F.zip_with(_words("_names", "\n"), _words("_labels", "\n"), lambda t, l: F.struct(t.alias("text"), l.alias("label")))
    return df.withColumns({"tokens": _words("tokens", " "), "_entities": entity}).drop("_names", "_labels")


def enrich_articles(cleaned: DataFrame, key: str = "url", text_col: str = "content", k_topics: int = 20,
                    min_topic_size: int = fixed.MIN_TOPIC_SIZE, leaning_dim: DataFrame | None = None,
                    scorer: str | None = None, vectors: DataFrame | None = None,
                    class_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds pol_leaning, tokens/processed_content(_truncated), sentiment, topic_nr, topic,
    entities, entity_counts and related_topics to cleaned articles (one row per ``key``, which is not NULL).

    ``scorer`` names a registered batch scorer for the sentiment (default: the
    lexicon); ``vectors`` may hold precomputed document vectors (``key``,
    ``embedding``) instead of the TF-IDF default; ``class_col`` names a column that holds each article's topic
    number already, and no clustering is done. Without ``keep_text`` the result has no ``text_col``, and the text is
    not stored.
    """
    stop = spark_stopwords("german")
    a = enrich.assign_leaning(cleaned, leaning_dim) if "source" in cleaned.columns else cleaned
    # processed_content(_truncated) are derived from the tokens at the end, so
    # the checkpoint below does not store the text twice more.
    a = enrich.with_tokens(a, text_col, stop, text_columns=False)
    if scorer:
        a = enrich.apply_scorer(enrich.with_processed_text(a), scorer, "processed_content_truncated", "sentiment") \
            .drop("processed_content", "processed_content_truncated")
    else:
        a = enrich.lexicon_sentiment(a).drop("sentiment_score")
    a = a.withColumn("_entities", ent.capitalised_entities(text_col, stop=stop, gazetteer=ent.GAZETTEER))
    # The per-row text work is the expensive part and feeds the IDF fit, the
    # k-means fit, the entity counts and the final rows; it is written to the
    # checkpoint folder once instead of being recomputed by each of those jobs.
    a = cut_lineage(_pack(a if keep_text else a.drop(text_col)))

    if class_col is not None:
        clustered = a.withColumn("topic_nr", F.col(class_col).cast("int"))
    elif a.isEmpty():
        # A run without new articles: there is nothing to fit the models on, and
        # the result is the empty enriched table (a one-row probe of the checkpoint).
        clustered = a.withColumn("topic_nr", F.lit(-1).cast("int"))
    else:
        if vectors is not None:
            vec = a.select(key).join(vectors.select(key, F.col("embedding").alias("_vec")), key, "left")
        else:
            # k-means reads its vectors some thirty times. By itself it keeps them all as objects on the executors' heaps; on
            # disk they are read in batches of a few MB, by the fit, by the cluster sizes and by the prediction.
            vec = topics.tfidf_vectors(a.select(key, _words("tokens", " ").alias("tokens")), "tokens", "_vec") \
                .select(key, "_vec").persist(StorageLevel.DISK_ONLY)
        # Only key → topic number is stored a second time; the articles stay where they are, unless there are too many numbers.
        numbers = cut_lineage(topics.cluster_topics(vec, "_vec", k=k_topics, min_size=min_topic_size,
                                                    missing_as_outlier=vectors is not None).select(key, "topic_nr"))
        vec.unpersist()
        free_unused(a.sparkSession)
        clustered = lookup_join(a, numbers, key, "inner")
    clustered = _unpack(clustered)

    reps = topics.class_tfidf(clustered, "topic_nr")
    labels = cut_lineage(topics.label_topics(reps, topics.label_dim(clustered.sparkSession)))
    # One label row per topic number: a left lookup, and topics without a label (the outliers) get the text None.
    named = labels.select(F.col("topic").alias("topic_nr"), F.col("label").alias("topic"))
    out = lookup_join(clustered, named, "topic_nr", "left").withColumn("topic", F.coalesce("topic", F.lit("None")))

    out = out.withColumn("entities", F.col("_entities")).drop("_entities").withColumn("entity_counts", ent.entity_count_map("entities"))
    counts = ent.topic_entity_mentions(out)
    pairs = ent.related_topics(ent.top_entities(counts))
    return enrich.with_processed_text(ent.attach_related(out, pairs)).drop("tokens")


def document_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered end-to-end run over ``documents``: cleaned texts, then enrichment
    (rows-only check: clustering is iterative)."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("text", "content") \
        .dropna(how="any", subset=["doc_id", "lang", "source", "n_chars"])
    cleaned = drop_null_text(clean_content(d, "content"), "content")
    e = enrich_articles(cleaned, key="doc_id", k_topics=10, keep_text=False)
    return e.select("doc_id", "source", "pol_leaning", "sentiment", "topic_nr", "topic",
                    F.size("entities").alias("n_entities"), F.size("related_topics").alias("n_related"))


def class_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run with the outlet's number as the given topic number, over texts that hold German marker and label words:
    without k-means every step is checked in SQL."""
    d = texts.labelled_text(spark, sf_dir).dropna(how="any", subset=["doc_id", "lang", "source", "n_chars"]) \
        .withColumn("content", F.concat(F.lit(texts.GERMAN), "text")).drop("text") \
        .withColumn("number", F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"))
    cleaned = drop_null_text(clean_content(d, "content"), "content")
    e = enrich_articles(cleaned, key="doc_id", class_col="number", keep_text=False)
    return e.select("doc_id", "source", "sentiment", "topic_nr", "topic", F.size("entities").alias("n_entities"),
                    F.size("entity_counts").alias("n_names"), F.size("related_topics").alias("n_related"))


SPARK = {"document_enrichment": document_enrichment, "class_enrichment": class_enrichment}

_NAMES = S.entity_spans("text", texts.STOP)
ORACLE: dict[str, str] = {"class_enrichment": f"""WITH labelled AS (SELECT l.*, {S.q(texts.GERMAN)} || l.text AS c FROM ({texts.LABELLED}) l
  JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL AND d.source IS NOT NULL AND d.n_chars IS NOT NULL),
s2 AS (SELECT doc_id, source, {S.null_unless_german(S.null_if_mojibake('c'))} AS c2 FROM labelled),
s4 AS (SELECT doc_id, source, c3, {S.trim_after('c3')} AS c4 FROM (SELECT *, {S.remove_snippets('c2')} AS c3 FROM s2)),
cleaned AS (SELECT doc_id, source, {S.null_if_blank('c5')} AS text FROM (SELECT *, {S.clean_text('c4')} AS c5 FROM s4)
            WHERE {S.null_if_blank('c5')} IS NOT NULL),
{texts.topic_label_ctes('cleaned')},
lab AS (SELECT t.topic AS source, CASE WHEN score >= {fixed.TOPIC_LABEL_CUTOFF} THEN label ELSE 'None' END AS topic
        FROM (SELECT DISTINCT topic FROM top) t LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (topic)),
names AS (SELECT doc_id, source, unnest({_NAMES}) AS entity FROM cleaned),
per_doc AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_entities, CAST(count(DISTINCT entity) AS INTEGER) AS n_names FROM names GROUP BY 1),
counts AS (SELECT coalesce(lab.topic, 'None') AS topic, entity, count(*) AS n FROM names LEFT JOIN lab USING (source) GROUP BY ALL),
tops AS (SELECT topic, entity FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, entity) AS rn FROM counts)
         WHERE rn <= {fixed.TOP_ENTITIES}),
rel AS (SELECT a.topic, CAST(count(DISTINCT b.topic) AS INTEGER) AS n_related FROM tops a JOIN tops b ON a.entity = b.entity AND a.topic <> b.topic
        GROUP BY 1),
sent AS (SELECT doc_id, coalesce(list_sum(list_transform(t, lambda w: CASE WHEN list_contains({S.str_list(enrich.POSITIVE_WORDS)}, w) THEN 1
         WHEN list_contains({S.str_list(enrich.NEGATIVE_WORDS)}, w) THEN -1 ELSE 0 END)), 0) AS score FROM tok)
SELECT doc_id, source, CASE WHEN sent.score > 0 THEN 'positive' WHEN sent.score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
       TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS topic_nr, coalesce(lab.topic, 'None') AS topic,
       coalesce(n_entities, 0) AS n_entities, coalesce(n_names, 0) AS n_names, coalesce(n_related, 0) AS n_related
FROM cleaned JOIN sent USING (doc_id) LEFT JOIN lab USING (source) LEFT JOIN per_doc USING (doc_id)
LEFT JOIN rel ON rel.topic = coalesce(lab.topic, 'None')"""}
