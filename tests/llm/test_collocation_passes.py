"""Phrases that the sample misses are settled in the one exact pass, whatever their length."""

import random
from collections import Counter

from newslens.llm import collocations as C


def test_missed_phrases_of_all_lengths_need_no_further_pass(spark, monkeypatch):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, "en", " ".join(rnd.choice(vocabulary) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    kept = {r.doc_id for r in df.where("pmod(xxhash64(doc_id, 13), 4) <> 0").collect()}
    # words that stand in no document of the sample: nothing of these phrases is proposed
    docs = [(i, lang, text + " new york city hall . old york city hall" * 3 if i in kept else text) for i, lang, text in docs]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    passes, count = [], C.phrase_counts
    monkeypatch.setattr(C, "phrase_counts", lambda *a, **k: passes.append(1) or count(*a, **k))
    got = {(r.k, r.phrase): r.f for r in C.frequent_phrases(df, 30).collect()}
    want = Counter()
    for _, _, text in docs:
        for piece in text.split("."):
            w = piece.split()
            want[0, ""] += len(w)
            want.update((k, " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == {p: n for p, n in want.items() if n >= 30 or not p[0]}
    assert got[4, "new york city hall"] == 3 * len(kept) and len(passes) == 1
