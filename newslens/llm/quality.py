"""Quality classifier: attention-based multiple-instance learning in numpy.

A document is a bag of passages (windows of its text). Every passage is encoded from the frequencies of its character-class
bigrams and hashed trigrams and from how often it repeats words; gated attention, learned from document labels alone,
weighs the passages, and a logistic output scores the weighted sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import char_chunks, code_points, crc_mod, map_batches
from newslens.llm.toxicity import labelled_sample
from newslens.sources.tables import table

PASSAGE = 512
TRIGRAMS = 128
HIDDEN, GATE = 24, 12
MAX_LABELLED, MAX_CHARS, HELD_OUT = 4000, 20_000, 0.2
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.01, 1e-4
THRESHOLD = 0.3
LAGS = (1, 2, 3)

#: Character classes; a character that fits none of them is of the class ``len(CLASSES) + 1``, a letter beyond
#: ASCII of the class ``len(CLASSES)``.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",;:", "!", "?",
           "|", "*", "%&$#@~^", "\"'()[]{}", "-_/\\+=<>")
KINDS = len(CLASSES) + 2
FEATURES = KINDS * KINDS + TRIGRAMS + len(LAGS)
_SMALL = np.uint32(0x9E3779B1)


def class_table() -> np.ndarray:
    out = np.full(0x110000, KINDS - 1, np.uint8)
    for c in range(128, 0x110000):
        if chr(c).isalpha():
            out[c] = KINDS - 2
    for k, chars in enumerate(CLASSES):
        for ch in chars:
            out[ord(ch)] = k
    return out


def _word_repeats(c: np.ndarray, space: np.ndarray, text: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """(n x lags): the share of each passage's words that equal the word 1, 2 or 3 before them."""
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1] | (text[1:] != text[:-1]))))
    out = np.zeros((n, len(LAGS)), np.float32)
    if not len(start):
        return out
    # a word's hash: its letters times odd numbers that depend on their place in the word, summed
    place = np.arange(len(c), dtype=np.uint32) - np.repeat(np.concatenate(([0], start)).astype(np.uint32),
                                                           np.diff(np.concatenate(([0], start, [len(c)]))))
    with np.errstate(over="ignore"):
        mixed = (c ^ (place * np.uint32(0x85EBCA77))) * _SMALL
        mixed = (mixed ^ (mixed >> np.uint32(15))) * ~space
        words = np.add.reduceat(mixed, start, dtype=np.uint64)
    owner = where[start]
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    for k, lag in enumerate(LAGS):
        same = np.concatenate([np.zeros(min(lag, len(words)), bool),
                               (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])])
        out[:, k] = np.bincount(owner, same, n) / count
    return out


def passages(texts: Sequence[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, its text). Each text has one passage at least; an empty one is all zeros."""
    lengths = np.array([len(t) for t in texts], np.int64)
    per = np.maximum(1, -(-lengths // PASSAGE))
    base, n = np.cumsum(per) - per, int(per.sum())
    x, text = np.zeros((n, FEATURES), np.float32), np.repeat(np.arange(len(texts)), per)
    c = code_points("".join(texts))
    if not len(c):
        return x, text
    owner = np.repeat(np.arange(len(texts)), lengths)
    where = base[owner] + (np.arange(len(c)) - (np.cumsum(lengths) - lengths)[owner]) // PASSAGE
    size = np.bincount(where, minlength=n)
    kind = classes[c].astype(np.int64)
    pair = kind[:-1] * KINDS + kind[1:]
    inside = where[:-1] == where[1:]
    two = np.bincount(np.compress(inside, where[:-1] * (KINDS * KINDS) + pair), minlength=n * KINDS * KINDS)
    with np.errstate(over="ignore"):
        h = (c[:-2] * _SMALL + c[1:-1]) * _SMALL + c[2:]
        bucket = ((h * _SMALL) >> np.uint32(33 - TRIGRAMS.bit_length())).astype(np.int64)
    inside = where[:-2] == where[2:]
    three = np.bincount(np.compress(inside, where[:-2] * TRIGRAMS + bucket), minlength=n * TRIGRAMS)
    share = (1 / np.maximum(size, 1)).astype(np.float32)[:, None]
    x[:, :KINDS * KINDS] = np.sqrt(two.reshape(n, -1).astype(np.float32) * share)
    x[:, KINDS * KINDS:-len(LAGS)] = np.sqrt(three.reshape(n, -1).astype(np.float32) * share)
    x[:, -len(LAGS):] = _word_repeats(c, (kind == 3) | (kind == 4), owner, where, n)
    return x, text


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class QualityModel:
    """Encoder (W, b), gated attention (V, U, a) and logistic output (o, c)."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)),
                  "U": r.normal(0, 0.3, (HIDDEN, GATE)), "a": r.normal(0, 0.3, GATE), "o": r.normal(0, 0.3, HIDDEN),
                  "c": np.zeros(1)}
        self.classes, self.scale, self.shift = class_table(), 1.0, 0.0

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"].astype(np.float32) + p["b"])
        tan, gate = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (tan * gate) @ p["a"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        w = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(w[:, None] * h, starts)
        return {"h": h, "tan": tan, "gate": gate, "w": w, "z": z, "out": z @ p["o"] + p["c"][0]}

    def gradients(self, x: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log loss, for the documents numbered 0.. in ``text``."""
        p, n = self.p, len(y)
        starts = np.searchsorted(text, np.arange(n))
        sizes = np.diff(np.append(starts, len(text)))
        f = self._forward(x, starts, sizes)
        e = (_sigmoid(f["out"]) - y) / n
        dz = e[:, None] * p["o"]
        dz_of = np.repeat(dz, sizes, 0)
        pull = (dz_of * f["h"]).sum(1)
        ds = f["w"] * (pull - np.repeat(np.add.reduceat(f["w"] * pull, starts), sizes))
        dtan = ds[:, None] * p["a"] * f["gate"] * (1 - f["tan"] ** 2)
        dgate = ds[:, None] * p["a"] * f["tan"] * f["gate"] * (1 - f["gate"])
        dh = (f["w"][:, None] * dz_of + dtan @ p["V"].T + dgate @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dtan, "U": f["h"].T @ dgate,
                "a": (f["tan"] * f["gate"]).T @ ds, "o": f["z"].T @ e, "c": np.array([e.sum()])}

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 0) -> "QualityModel":
        """Adam on the log loss with weight decay; a fifth of the texts only sets the final scale and shift. Without
        texts every score is about one half."""
        rnd = np.random.default_rng(seed)
        held = rnd.random(len(texts)) < HELD_OUT
        learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
        bags = [passages([texts[i]], self.classes)[0] for i in learn]
        m, v, step = {k: 0 * x for k, x in self.p.items()}, {k: 0 * x for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS if len(learn) else 0):
            order = rnd.permutation(len(learn))
            for at in np.array_split(order, max(1, len(order) // BATCH)):
                text = np.repeat(np.arange(len(at)), [len(bags[i]) for i in at])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in at]), text, y[learn[at]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    move = m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.p[k] = self.p[k] - RATE * (1 - epoch / EPOCHS) * (move + DECAY * self.p[k])
        check = np.flatnonzero(held) if held.any() else learn
        if len(check):
            self._calibrate(self.logits([texts[i] for i in check]), y[check])
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The scale and shift of least log loss on held-out documents, with targets a little inside 0 and 1."""
        target = np.where(y > 0, 1 - 1 / (2 + y.sum()), 1 / (2 + (1 - y).sum()))
        best = None
        for scale in np.exp(np.linspace(-2, 2, 41)):
            for shift in np.linspace(-4, 4, 41):
                q = scale * z + shift
                loss = (np.logaddexp(0, q) - target * q).mean()
                if best is None or loss < best[0]:
                    best = (loss, float(scale), float(shift))
        _, self.scale, self.shift = best

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in char_chunks(texts):
            x, text = passages(texts[a:b], self.classes)
            starts = np.searchsorted(text, np.arange(b - a))
            out[a:b] = self._forward(x, starts, np.diff(np.append(starts, len(text))))["out"]
        return out

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(texts) + self.shift)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold (crc32 of the key modulo 5 is 0)."""
    return QualityModel().fit(*labelled_sample(docs, labels, "quality", key, text, rows=rows, chars=MAX_CHARS))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row's whole text. NULL counts as empty, and an empty text has the score of one
    empty passage. Repeated rows and rows without a key stay. Further columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(b: pa.RecordBatch) -> dict:
        s = shared.value.scores([t or "" for t in b.column(1).to_pylist()])
        return {key: b.column(0), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(docs.select(F.col(key), F.col(text)), run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted to be of good quality, unchanged and without a shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    return map_batches(docs, lambda b: b.filter(pa.array(
        shared.value.scores([t or "" for t in b.column(at).to_pylist()]) >= THRESHOLD)), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"))) \
        .select("doc_id", held.alias("held_out"), "score", "predicted")
