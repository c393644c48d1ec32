"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import char_chunks, code_points, crc_mod, map_batches
from newslens.llm.subword import SubwordSoftmax, batches, fold_table, softmax, take, temperature
from newslens.sources.tables import table

SIZES, BITS, DIM = (1, 2, 3, 4), 16, 16
#: Rows per language that the model is fitted on, at most, and the length of the snippets cut from them.
MAX_PER_LANGUAGE, SNIPPET_CHARS = 800, 240
EPOCHS, BATCH, RATE, HELD_OUT = 6, 64, 0.3, 0.2
#: Share of the accepted predictions that shall be right on the held-out snippets.
PRECISION = 0.995
UNKNOWN = "und"


class LanguageModel:
    """``languages`` in the order of the softmax's classes; without any, every text is unknown."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.net = SubwordSoftmax(max(1, len(languages)), SIZES, BITS, DIM)
        self.scale, self.accept = 1.0, 0.0

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 0) -> "LanguageModel":
        """SGD on four fifths of the texts; the rest set the softmax's temperature and the probability below which a
        prediction is rejected."""
        rnd = np.random.default_rng(seed)
        held = rnd.random(len(texts)) < HELD_OUT
        learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
        bags, eye = [self.net.bags([texts[i]]) for i in learn], np.eye(max(1, len(self.languages)))
        for epoch in range(EPOCHS if len(texts) else 0):
            for at in batches(len(learn), BATCH, rnd):
                part = take(bags, at)
                self.net.step(part, (softmax(self.net.logits(part)) - eye[y[learn[at]]]) / len(at),
                              RATE * (1 - epoch / EPOCHS))
        self.net.freeze()
        check = np.flatnonzero(held) if held.any() else learn
        if len(check):
            z = self.net.logits(self.net.bags([texts[i] for i in check]))
            self.scale = temperature(z, y[check])
            p = softmax(z * self.scale)
            right, top = p.argmax(1) == y[check], p.max(1)
            order = np.argsort(-top)
            good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
            self.accept = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its probability, accepted) of each text; unknown with 0 if there is no letter."""
        names, score = np.array([*self.languages, UNKNOWN], object), np.zeros(len(texts))
        best = np.full(len(texts), len(self.languages))
        plain = [t or "" for t in texts]
        fold = fold_table()
        for a, b in char_chunks(plain) if self.languages else ():
            p = softmax(self.net.logits(self.net.bags(plain[a:b])) * self.scale)
            lettered = np.array([bool((fold[code_points(t)] != 32).any()) for t in plain[a:b]])
            best[a:b] = np.where(lettered, p.argmax(1), best[a:b])
            score[a:b] = np.where(lettered, p.max(1), 0.0)
        return names[best].tolist(), score, (score >= self.accept) & (best < len(self.languages))


#: Keys that a language's pick is made from, per key picked: what one task ranks does not grow with the language.
SPARE = 4


def snippets(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: tuple[int, int] = (4, 2),
             rows: int = MAX_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """(texts, languages) to learn from: per language at most ``rows`` documents, those with the smallest hashes of the
    key, none of whose keys' crc32 modulo ``fold[0]`` is ``fold[1]``; of each its start, a short and a longer one, and
    its end. A language's own count bounds the hashes that are ranked, so one with few documents keeps them all."""
    mine = docs.where(F.col(lang).isNotNull() & (crc_mod(key, fold[0]) != fold[1]))
    share = mine.groupBy(F.col(lang).alias("_l")).agg((SPARE * rows / F.approx_count_distinct(key)).alias("_s"))
    small = (F.col("_s") >= 1) | (F.xxhash64(key).cast("double") < (2 * F.col("_s") - 1) * float(1 << 63))
    first = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)  # cut to ``rows`` a language before the shuffle
    ids = mine.select(key, lang).join(F.broadcast(share), F.col(lang) == F.col("_l")).where(small).select(key, lang) \
        .distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows)
    start, end = F.substring(F.col(text), 1, SNIPPET_CHARS), F.substring(F.col(text), -SNIPPET_CHARS, SNIPPET_CHARS)
    cuts = [F.substring(start, 1, SNIPPET_CHARS // 4), start, F.when(F.length(text) > SNIPPET_CHARS, end).otherwise(start)]
    got = mine.where(F.col(text).isNotNull()).join(F.broadcast(ids.select(key, lang)), [key, lang]) \
        .select(key, F.col(lang).alias("l"), F.array_distinct(F.array(*cuts)).alias("c")).dropDuplicates([key, "l"]) \
        .orderBy("l", key).select("l", F.explode("c").alias("t")).collect()
    out = [(r.t, r.l) for r in got]
    return [t for t, _ in out], [n for _, n in out]


def train(docs: DataFrame, **options) -> LanguageModel:
    texts, langs = snippets(docs, **options)
    names = sorted(set(langs))
    return LanguageModel(names).fit(texts, np.array([names.index(x) for x in langs], int))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) for every row's whole text. ``lang_pred`` is a learned language, or ``und``
    (score 0) where the text is NULL or has no letter; ``accepted`` is false where the probability is below the
    calibrated bound. Repeated rows and rows without a key stay. Further columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(b: pa.RecordBatch) -> dict:
        lang, score, ok = shared.value.predict(b.column(1).to_pylist())
        return {key: b.column(0), "lang_pred": lang, "score": score, "accepted": ok}

    return map_batches(docs.select(F.col(key), F.col(text)), run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
