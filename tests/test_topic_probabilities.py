"""Topic probabilities against cosines of every window."""

import random
from collections import Counter, defaultdict
from math import sqrt

from newslens.operators.topics import topic_probabilities


def _brute(docs, terms, window):
    vectors = defaultdict(dict)
    for topic, term, score in terms:
        vectors[topic][term] = score
    out = {}
    for key, tokens in docs:
        if key is None or not tokens:
            continue
        w, per = min(window, len(tokens)), Counter()
        for i in range(len(tokens) - w + 1):
            counts = Counter(tokens[i:i + w])
            for topic, v in vectors.items():
                norm = sqrt(sum(c * c for c in counts.values())) * sqrt(sum(s * s for s in v.values()))
                if norm:
                    per[topic] += w * sum(c * v.get(t, 0.0) for t, c in counts.items()) / norm
        total = sum(per.values())
        out |= {(key, t): p / total for t, p in per.items() if p > 0}
    return out


def test_against_all_windows(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 30))]) for i in range(40)]
    docs += [(100, ["w1"]), (101, []), (102, None), (103, ["none", "of", "them"]), (None, ["w1"]), (104, ["w1"] * 200)]
    terms = [(t, w, round(rnd.random(), 3)) for t in ("a", "b", "c") for w in rnd.sample(words, 5)] + [("zero", "w2", 0.0)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, tokens array<string>, term string").repartition(3)
    table = spark.createDataFrame(terms, "topic string, term string, score double")
    for window in (1, 4):
        got = {(r.doc_id, r.topic): r.probability for r in topic_probabilities(df, table, "doc_id", window=window).collect() if r.probability}
        want = _brute(docs, terms, window)
        assert got.keys() == {k for k, p in want.items() if round(p, 6)} and len(want) > 80
        assert all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert topic_probabilities(df.limit(0), table, "doc_id").collect() == []


def test_the_terms_are_broadcast_and_not_the_documents(spark, tmpdir_run):
    """A small file holds many tokens once they are counted by document and term."""
    spark.createDataFrame([(i, ["w1", "w2", f"x{i}"], "x") for i in range(50)], "doc_id long, tokens array<string>, f string") \
        .write.parquet(f"{tmpdir_run}/docs")
    table = spark.createDataFrame([("a", "w1", 1.0), ("b", "w2", 1.0)], "topic string, term string, score double")
    out = topic_probabilities(spark.read.parquet(f"{tmpdir_run}/docs"), table, "doc_id")
    joins = [j for j in out._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin" in j and "term" in j]
    assert len(joins) >= 2 and all("BuildRight" in j for j in joins)
    assert {tuple(r) for r in out.collect()} == {(i, t, 0.5) for i in range(50) for t in "ab"}
