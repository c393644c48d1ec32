"""Toxicity: subword-bag embeddings averaged into a linear softmax, over short passages of a document.

A toxic word would drown in the mean of a long text, so the mean is taken over passages of a few words, and a
document's score is that of its most toxic passage. Training sees document labels only: the first rounds
learn from the mean of all passages, the later ones from the passage that scores highest at the time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import char_chunks, crc_mod, map_batches, take_ids
from newslens.llm.subword import SubwordSoftmax, batches, softmax, take
from newslens.sources.tables import table

SIZES, BITS, DIM, WORDS = (3, 4, 5, 6), 17, 8, 4
#: Labelled rows that the model is fitted on, at most; texts longer than the bound are not used to learn from.
MAX_LABELLED, MAX_CHARS = 5000, 20_000
HELD_OUT = 0.2
WARM, EPOCHS, BATCH, RATE = 3, 9, 64, 0.5
THRESHOLD = 0.5


class ToxicityModel:
    def __init__(self):
        self.net = SubwordSoftmax(2, SIZES, BITS, DIM, WORDS, digits=True)
        self.scale, self.shift = 1.0, 0.0

    def margins(self, texts: list[str]) -> np.ndarray:
        """The highest log odds of a passage of each text; texts are cut and scored many at a time."""
        out = np.empty(len(texts))
        for a, b in char_chunks(texts):
            bags = self.net.bags(texts[a:b])
            z = self.net.logits(bags)
            starts = np.searchsorted(bags.text, np.arange(b - a))
            out[a:b] = np.maximum.reduceat(z[:, 1] - z[:, 0], starts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(texts) + self.shift, -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 0) -> "ToxicityModel":
        """Learn from texts and labels; a fifth of them only sets the final scale and shift."""
        if not len(texts):
            self.net.freeze()
            return self
        rnd = np.random.default_rng(seed)
        held = rnd.random(len(texts)) < HELD_OUT
        learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
        bags = [self.net.bags([texts[i]]) for i in learn]
        ys = y[learn].astype(int)
        for epoch in range(WARM + EPOCHS):
            rate = RATE * (1 - epoch / (WARM + EPOCHS))
            for at in batches(len(learn), BATCH, rnd):
                part = take(bags, at)
                z = self.net.logits(part)
                if epoch < WARM:
                    n = np.bincount(part.text, minlength=len(at))
                    weight = 1.0 / n[part.text]
                    e = softmax(z) - np.eye(2)[ys[at]][part.text]
                else:
                    margin = z[:, 1] - z[:, 0]
                    top = np.lexsort((-margin, part.text))
                    top = top[np.unique(part.text[top], return_index=True)[1]]
                    weight = np.zeros(part.n)
                    weight[top] = 1
                    e = softmax(z) - np.eye(2)[ys[at]][part.text]
                self.net.step(part, e * weight[:, None] / len(at), rate)
        self.net.freeze()
        check = np.flatnonzero(held) if held.any() else learn
        self._calibrate(self.margins([texts[i] for i in check]), y[check])
        return self

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Shift so that 0.5 falls where held-out errors are fewest (the middle of that stretch), then scale by
        log loss."""
        order = np.sort(m)
        cuts = np.concatenate(([order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]))
        wrong = np.array([((m >= c) != (y > 0)).sum() for c in cuts])
        best = cuts[wrong == wrong.min()]
        cut = float((best[0] + best[-1]) / 2)
        grid = np.exp(np.linspace(-3, 3, 61))
        loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * s * (m - cut)).mean() for s in grid]
        self.scale = float(grid[int(np.argmin(loss))])
        self.shift = -self.scale * cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
                    fold: tuple[int, int] = (5, 0), rows: int = MAX_LABELLED, chars: int = MAX_CHARS) -> tuple[list, np.ndarray]:
    """(texts, labels) of at most ``rows`` labelled documents, picked by a hash of the key, none of whose keys' crc32
    modulo ``fold[0]`` is ``fold[1]``, and no text longer than ``chars``."""
    mine = labels.where(F.col(label).isNotNull() & (crc_mod(key, fold[0]) != fold[1])).groupBy(key) \
        .agg(F.max(label).alias("_y"))
    ids = F.broadcast(take_ids(mine, key, rows))  # at most ``rows`` rows
    got = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(ids, key) \
        .where(F.length("_t") <= chars).orderBy(key, F.xxhash64("_t")).limit(rows).select("_t", "_y").toPandas()
    return got["_t"].tolist(), got["_y"].to_numpy(np.int64)


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row. NULL counts as empty; a text without letters or digits has the score of
    an empty passage. Repeated rows and rows without a key stay. Further columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(b: pa.RecordBatch) -> dict:
        s = shared.value.scores([t or "" for t in b.column(1).to_pylist()])
        return {key: b.column(0), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(docs.select(F.col(key), F.col(text)), run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ToxicityModel().fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
