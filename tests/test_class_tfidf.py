"""Class TF-IDF counts few bigrams and gives what counting all of them gives."""

import math
import random
from collections import Counter, defaultdict

import pytest

from newslens.operators import topics


def _brute(rows, top_n):
    tf = defaultdict(Counter)
    for c, t in rows:
        if c is not None and t is not None:
            tf[c].update(w for w in t if w is not None)
            tf[c].update(" ".join(w for w in p if w is not None) for p in zip(t, t[1:]))
    tf = {c: n for c, n in tf.items() if n}
    freq = sum(tf.values(), Counter())
    avg = math.floor(sum(sum(n.values()) for n in tf.values()) / len(tf)) if tf else 0
    out = []
    for c, n in tf.items():
        words = sum(n.values())
        best = sorted((-k / words * math.log(avg / freq[t] + 1.0), t) for t, k in n.items())[:top_n]
        out += [(c, i + 1, t, round(-s, 6)) for i, (s, t) in enumerate(best)]
    return sorted(out)


def _rows(n=300):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{int(60 * rnd.random() ** 3)}" for _ in range(rnd.randint(0, 40))] + [f"only{i}"]
        for at in range(0, len(words), 9):
            words[at:at] = [f"red{i % 4}", "car"]
        rows.append((f"c{i % 4}", words))
    return rows + [("few", ["a", "b", "a", "b", "c"]), ("one", ["w1"]), ("none", []), ("null", None), (None, ["w1", "w2"])]


def _got(spark, rows, top_n):
    df = spark.createDataFrame(rows, "c string, tokens array<string>").repartition(3)
    return sorted((r.topic, r["rank"], r.term, round(r.score, 6)) for r in topics.class_tfidf(df, "c", top_n=top_n, digits=9).collect())


@pytest.mark.parametrize("top_n,literals", [(1, 1000), (8, 1000), (8, 2)])
def test_top_terms_are_those_of_a_full_count(spark, monkeypatch, top_n, literals):
    monkeypatch.setattr(topics, "LITERAL_WORDS", literals)
    got = _got(spark, _rows(), top_n)
    assert got == _brute(_rows(), top_n) and (top_n == 1 or any(" " in r[2] for r in got))


@pytest.mark.parametrize("odd", [["a b", "c", "a", "b c"], ["a", None, "b", "a"], ["", "a", "", "a"]])
def test_tokens_with_blanks_or_nulls(spark, odd):
    rows = [("x", odd), ("y", ["a", "b", "c", "a", "b"]), ("y", odd * 2)]
    assert _got(spark, rows, 5) == _brute(rows, 5)


def test_few_bigrams_are_counted(spark, monkeypatch):
    kept, cut = [], topics.cut_lineage
    monkeypatch.setattr(topics, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [r for r in _rows() if r[0] and r[0].startswith("c")]
    assert _got(spark, rows, 8) == _brute(rows, 8)
    pairs = sum(len(n) for n in _pairs(rows).values())
    assert sum(d.where("term like '% %'").count() for d in kept if "term" in d.columns) < pairs / 4


def _pairs(rows):
    out = defaultdict(set)
    for c, t in rows:
        out[c].update(zip(t, t[1:]))
    return out
