"""Topics: clustering of document vectors, class-based TF-IDF representation, labelling."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import text as tx
from newslens.functions.scores import spark_stopwords
from newslens.operators.joins import lookup_join
from newslens.session import cut_lineage

#: Words that are looked up inside the texts, as literals; more of them are joined.
LITERAL_WORDS = 1000


def cluster_topics(df: DataFrame, vector_col: str = "embedding", k: int = 10,
                   min_size: int = fixed.MIN_TOPIC_SIZE, seed: int = fixed.RANDOM_SEED,
                   max_iter: int = 20, missing_as_outlier: bool = False) -> DataFrame:
    """Topic number per row from seeded k-means on the vectors; clusters with fewer than
    ``min_size`` members become the outlier topic -1.

    With ``missing_as_outlier`` (vectors supplied from elsewhere, possibly not for
    every row) the model is fitted on the rows that have a vector and the rows
    without one get the outlier topic -1.

    ``max_iter`` bounds the iterations: k-means then stops where it is, as Spark's default does.

    The cluster sizes come from the training summary of the fitted model (the
    last pass of the fit assigns every training row), so the outlier rule is a
    literal list of at most ``k`` cluster ids: no extra pass over the rows and
    no join.

    A column of vectors is fitted as it is, so ``df`` may be persisted: k-means then reads it from there. If it is not,
    k-means keeps all vectors as objects on the executors' heaps while it runs.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import VectorUDT

    is_vector = isinstance(df.schema[vector_col].dataType, VectorUDT)
    src = df.where(F.col(vector_col).isNotNull()) if missing_as_outlier else df
    vec = src if is_vector else src.withColumn("_features", array_to_vector(F.col(vector_col)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=vector_col if is_vector else "_features",
                   predictionCol="_cluster").fit(vec)
    sizes = model.summary.clusterSizes
    kept = [i for i, n in enumerate(sizes) if n >= min_size]
    pred = model.transform(vec).drop("_features")
    topic = F.when(F.col("_cluster").isin(*kept), F.col("_cluster")) if kept else F.lit(None)
    out = pred.withColumn("topic_nr", F.coalesce(topic, F.lit(-1)).cast("int")).drop("_cluster")
    if missing_as_outlier:
        out = out.unionByName(df.where(F.col(vector_col).isNull()).withColumn("topic_nr", F.lit(-1).cast("int")))
    return out


def tfidf_vectors(df: DataFrame, tokens_col: str = "tokens", out_col: str = "features",
                  num_features: int = 1 << 16) -> DataFrame:
    """Sparse TF-IDF vectors of the token lists (hashing trick, so no vocabulary pass).

    ``num_features`` is the width of the vectors: words that share a bucket count as one, more of them the larger the
    vocabulary is, and every k-means iteration broadcasts and sums k dense centres of that width. Choose it by the
    vocabulary; the results depend on it.

    The default document vectors for clustering when no sentence-embedding
    model is plugged in through ``enrich.score_in_batches``.
    """
    from pyspark.ml.feature import IDF, HashingTF

    tf = HashingTF(inputCol=tokens_col, outputCol="_tf", numFeatures=num_features).transform(df)
    return IDF(inputCol="_tf", outputCol=out_col).fit(tf).transform(tf).drop("_tf")


def class_word_counts(df: DataFrame, class_col: str, tokens_col: str = "tokens") -> DataFrame:
    """(topic, term, tf, texts): occurrences of every token per class, and how many texts of the class begin with it."""
    words = df.where(F.col(class_col).isNotNull()).select(F.col(class_col).alias("topic"), F.posexplode(tokens_col).alias("at", "term"))
    return words.groupBy("topic", "term").agg(F.count("*").alias("tf"), F.count_if(F.col("at") == 0).alias("texts"))


def class_pair_counts(df: DataFrame, class_col: str, tokens_col: str, words: DataFrame) -> DataFrame:
    """(topic, term, tf): occurrences per class of the bigrams whose two tokens are both in ``words`` (term, distinct)."""
    t, known = F.col(tokens_col), [r[0] for r in words.limit(LITERAL_WORDS + 1).collect()]
    few = len(known) <= LITERAL_WORDS  # then pairs are left out inside the texts, before they become rows

    def pair(x, i):
        p = F.struct(x.alias("first"), F.get(t, i + 1).alias("second"))
        return F.when(x.isin(*known), p) if few else p

    pairs = F.transform(t, pair)
    pairs = F.filter(pairs, lambda p: p["second"].isin(*known)) if few else pairs
    found = df.where(F.col(class_col).isNotNull()).select(F.col(class_col).alias("topic"), F.explode(pairs).alias("p")) \
        .select("topic", "p.first", "p.second")
    if not few:
        for side in ("first", "second"):  # the last token has no second one
            found = lookup_join(found, words.withColumnRenamed("term", side), side, "left_semi")
    return found.groupBy("topic", "first", "second").agg(F.count("*").alias("tf")) \
        .select("topic", F.concat_ws(" ", "first", "second").alias("term"), "tf")


def class_term_counts(df: DataFrame, class_col: str, tokens_col: str = "tokens") -> DataFrame:
    """Occurrences of every unigram and bigram per class (partial aggregation before the shuffle)."""
    terms = df.where(F.col(class_col).isNotNull()).select(
        F.col(class_col).alias("topic"), F.explode(tx.unigrams_and_bigrams(tokens_col)).alias("term"))
    return terms.where(F.col("term").isNotNull()).groupBy("topic", "term").agg(F.count("*").alias("tf"))


def class_tfidf(df: DataFrame, class_col: str, tokens_col: str = "tokens",
                top_n: int = fixed.TOP_TOPIC_WORDS, digits: int = 9) -> DataFrame:
    """Top terms (tokens and pairs of neighbouring tokens) per class by class-based TF-IDF (Grootendorst 2022):

        score(t, c) = tf(t, c) / words(c) * ln(1 + A / f(t))

    with words(c) the term occurrences of the class, f(t) the occurrences of t
    over all classes and A the mean of words(c), truncated to an integer.
    Ties are broken by term.

    Nearly all distinct terms are bigrams, and few of them can be among the top. As f(t) >= tf(t, c), no score exceeds
    tf(t, c) / words(c) * ln(1 + A / tf(t, c)), which grows with tf(t, c); and a bigram occurs no more often than either of
    its tokens. So the tokens are counted first, and bigrams only of tokens that reach, by that bound, the ``top_n``-th best
    token score of some class. The result is the one that counting all of them gives; a class of fewer tokens keeps all of
    its bigrams. Where tokens hold blanks or are NULL, a bigram may read like a token, and every term is counted.

    The counts are written to the checkpoint folder. f(t) is a window sum partitioned by term: a term has at most one row
    per class, so no window partition grows with the corpus. words(c) and A form a table with one row per class; it is
    broadcast if its measured size is small, so the counts are not shuffled by class, where one class may hold a third of
    the text.
    """
    words = cut_lineage(_with_freq(class_word_counts(df, class_col, tokens_col)))
    if words.where(F.col("term").isNull() | F.col("term").contains(" ")).isEmpty():
        per_class = _per_class(words, 2 * F.sum("tf") - F.sum("texts"))  # a text has one bigram less than tokens
        scored = _scored(words, per_class)
        best = cut_lineage(_top(scored, top_n))
        last = best.groupBy("topic").agg(F.when(F.count("*") == top_n, F.min("score")).otherwise(0.0).alias("least"))
        most = F.col("tf") / F.col("class_words") * F.log(F.col("avg_words") / F.col("tf") + 1.0)
        able = lookup_join(scored, cut_lineage(last), "topic", "inner").where(most >= F.col("least") * (1 - 1e-9))
        pairs = class_pair_counts(df, class_col, tokens_col, cut_lineage(able.select("term").distinct()))
        pairs = _scored(cut_lineage(_with_freq(pairs)), per_class)
        scored = best.select("topic", "term", "score").unionByName(pairs.select("topic", "term", "score"))
    else:
        counts = cut_lineage(class_term_counts(df, class_col, tokens_col))
        scored = _scored(_with_freq(counts), _per_class(counts, F.sum("tf")))
    return _top(scored, top_n).select(
        "topic", "rank", "term", (F.rint(F.col("score") * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)).alias("score"))


def _with_freq(counts: DataFrame) -> DataFrame:
    return counts.withColumn("term_freq", F.sum("tf").over(Window.partitionBy("term")))


def _per_class(counts: DataFrame, occurrences) -> DataFrame:
    """(topic, class_words, avg_words), one row per class: the mean over classes is a window over that small table."""
    per_class = counts.groupBy("topic").agg(occurrences.alias("class_words"))
    return cut_lineage(per_class.withColumn("avg_words", F.floor(F.avg("class_words").over(Window.partitionBy()))))


def _scored(counts: DataFrame, per_class: DataFrame) -> DataFrame:
    scored = lookup_join(counts, per_class, "topic", "inner")
    score = (F.col("tf") / F.col("class_words")) * F.log(F.col("avg_words") / F.col("term_freq") + 1.0)
    return scored.withColumn("score", score)


def _top(scored: DataFrame, top_n: int) -> DataFrame:
    # row_number() <= n is planned as a window group limit: each task keeps its
    # own top n per class before the shuffle by class.
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def topic_probabilities(df: DataFrame, terms: DataFrame, key: str, tokens_col: str = "tokens", window: int = 4,
                        digits: int = 6) -> DataFrame:
    """(key, topic, probability): how a document's tokens spread over the topics of ``terms`` (topic, term, score).

    Every window of ``window`` tokens (the whole document, if it is shorter) is compared with every topic by the cosine of
    its term counts and the topic's scores; a window's cosine goes to each of its tokens, and a document's sums are
    normalised to one. A cosine is a sum over the window's tokens, so a token adds its score, over the topic's norm,
    times one factor that no topic changes: the sum of size / norm of the windows around it. Those factors are added up
    per document and term before the terms are joined. A document without a topic's term, without tokens or key has no
    row. Scores are not negative.

    The terms are few beside the tokens: they are written to the checkpoint folder once, tokens that are no topic's term are
    left out before anything is added up, and both joins broadcast the terms if their measured size is small.
    """
    t, n = F.col(tokens_col), F.size(tokens_col)
    width = F.least(n, F.lit(window))
    norms = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.sqrt(F.aggregate(
        F.slice(t, i, width), F.lit(0), lambda a, x: a + F.size(F.filter(F.slice(t, i, width), lambda y: y == x)))))
    tokens = df.where(F.col(key).isNotNull() & (n > 0)).select(F.col(key), t.alias("_t"), width.alias("_w"), norms.alias("_n"))

    def factor(p):  # of the token at position p, from 0
        first = F.greatest(p - F.col("_w") + 2, F.lit(1))
        last = F.least(p + 1, F.size("_n"))
        return F.aggregate(F.slice("_n", first, last - first + 1), F.lit(0.0), lambda a, z: a + F.col("_w") / z)

    spread_ = tokens.select(key, F.explode(F.transform("_t", lambda x, p: F.struct(x.alias("term"), factor(p).alias("f")))).alias("x"))
    terms = cut_lineage(terms.select("topic", "term", "score"))
    norm = terms.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_norm"))
    weights = cut_lineage(terms.join(norm, "topic").where("_norm > 0").select("topic", "term", (F.col("score") / F.col("_norm")).alias("_s")))
    known = lookup_join(spread_.select(key, "x.term", "x.f"), weights.select("term").distinct(), "term", "left_semi")
    parts = known.groupBy(key, "term").agg(F.sum("f").alias("_f"))
    sums = lookup_join(parts, weights, "term", "inner").groupBy(key, "topic").agg(F.sum(F.col("_f") * F.col("_s")).alias("_p"))
    total = sums.groupBy(key).agg(F.sum("_p").alias("_all")).where("_all > 0")
    share = F.col("_p") / F.col("_all")
    return sums.join(total, key).select(key, "topic", (F.rint(share * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)).alias("probability"))


def topic_info(df: DataFrame, class_col: str, tokens_col: str = "tokens",
               top_n: int = fixed.TOP_TOPIC_WORDS) -> DataFrame:
    """One row per topic: number of documents and the representation (top terms by rank)."""
    reps = class_tfidf(df, class_col, tokens_col, top_n)
    rep = reps.groupBy("topic").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("representation"))
    sizes = df.groupBy(F.col(class_col).alias("topic")).agg(F.count("*").alias("n_docs"))
    return sizes.join(rep, "topic", "left")


# Label words have no upper length: compounds longer than the articles' tokens must stay reachable.
LABEL_WORD_MAX = 1 << 20
GRAM = 4


def label_dim(spark, labels: Sequence[str] = fixed.DISTINCT_TOPIC_LABELS,
              stop: Sequence[str] | None = None) -> DataFrame:
    """Candidate labels with the distinct character n-grams of their words (stop words left out), and how many."""
    stop = spark_stopwords("german") if stop is None else stop
    df = spark.createDataFrame([(lab,) for lab in labels], "label string")
    words = tx.drop_stopwords(tx.tokens("label", 2, LABEL_WORD_MAX), stop)
    df = df.withColumn("grams", F.array_distinct(F.flatten(F.transform(words, lambda w: tx.char_grams(w, GRAM)))))
    return df.select("label", F.size("grams").alias("label_grams"), F.explode("grams").alias("gram"))


def label_topics(reps: DataFrame, labels: DataFrame, cutoff: float = fixed.TOPIC_LABEL_CUTOFF,
                 digits: int = 9) -> DataFrame:
    """Best candidate label per topic by the character n-grams it shares with the representation terms.

    score = matched n-grams of the label / its n-grams: a label of several words needs them all for 1.0, and a
    compound is found through its parts, also where it is longer than a token may be. Among the labels whose score
    reaches ``cutoff``, the one with the highest score times matched n-grams is assigned (a compound beats a label that
    is but a part of it), the first by name among equals; if none does, the label is the text ``None``. Topics meet
    labels in an equi-join on the n-gram, without a hint: the label table is fixed and small, and is broadcast from its
    measured size.
    """
    reps = cut_lineage(reps.select("topic", "term"))
    grams = reps.select("topic", F.explode(F.split("term", " ")).alias("word")).distinct() \
        .select("topic", F.explode(tx.char_grams("word", GRAM)).alias("gram")).distinct()
    hits = grams.join(labels, "gram").groupBy("topic", "label", "label_grams").agg(F.count("*").alias("matched"))
    scored = hits.withColumn("score", F.col("matched") / F.col("label_grams"))
    order = F.struct((F.col("score") < cutoff), -(F.col("score") * F.col("matched")), F.col("label"))
    best = scored.groupBy("topic").agg(F.min_by(F.struct("label", "score"), order).alias("b"))
    out = reps.select("topic").distinct().join(best, "topic", "left")
    assigned = F.when(F.col("b.score") >= cutoff, F.col("b.label")).otherwise(F.lit("None"))
    return out.select("topic", assigned.alias("label"),
                      (F.rint(F.coalesce("b.score", F.lit(0.0)) * F.lit(10.0 ** digits))
                       / F.lit(10.0 ** digits)).alias("score"))
