"""Language, quality and toxicity: features against plain code, gradients by differences, held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newslens.llm import language as L
from newslens.llm import quality as Q
from newslens.llm import subword as W
from newslens.llm import toxicity as X
from newslens.sources.tables import table

SF = "/root/testdata/sf0.1"
ODD = [None, "", " \n", "123 !!", "a", "ß" * 3, "word " * 3000, "\U0001f600 é", "x" * 30000]


def test_bags_against_plain_ngrams():
    texts = ["Ab cd, cd", "", "é-Z", "a a a b", "one two three four five"]
    for sizes in ((1, 2), (3,), (2, 4)):
        got = W.cut_bags(texts, sizes, 31)
        want = Counter()
        for i, t in enumerate(texts):
            c = " " + re.sub(r"[^a-zé]", " ", t.lower()) + " "
            for n in sizes:
                for a in range(len(c) - n + 1):
                    g = c[a:a + n]
                    if g.strip() and " " not in g[1:-1]:
                        want[i, n, g] += 1
        assert len(got.ids) == sum(want.values())
        assert sorted(Counter(zip(got.bag.tolist(), got.ids.tolist())).values()) == sorted(want.values())
    bags = W.cut_bags(texts, (3,), 31, words=2)
    assert bags.text.tolist() == [0, 1, 2, 3, 4, 4, 4]
    assert bags.count().tolist() == W.cut_bags(["ab cd", "", "é Z", "a b", "one two", "three four", "five"], (3,), 31).count().tolist()


def test_bags_do_not_depend_on_neighbours():
    texts = ["ab cd ef gh", "", "ij kl", "mn"]
    net = W.SubwordSoftmax(3, (2, 3), 10, 4, words=2)
    alone = np.concatenate([net.logits(net.bags([t])) for t in texts])
    assert np.allclose(net.logits(net.bags(texts)), alone, atol=1e-6)
    assert np.allclose(net.freeze().logits(net.bags(texts)), alone, atol=1e-5)


def test_passage_features_against_plain():
    classes = Q.class_table()
    texts = ["Hello hello Hello x", "", "a b a b a b " * 90]
    x, text = Q.passages(texts, classes)
    assert text.tolist() == [0, 1, 2, 2, 2] and not x[1].any()
    for t, row in zip([texts[0], texts[2][:Q.PASSAGE]], x[[0, 2]]):
        pairs = Counter(int(classes[ord(a)]) * Q.KINDS + int(classes[ord(b)]) for a, b in zip(t, t[1:]))
        for k in range(Q.KINDS ** 2):
            assert row[k] == pytest.approx((pairs[k] / len(t)) ** 0.5, abs=1e-5)
        words = t.split()
        for k, lag in enumerate(Q.LAGS):
            assert row[k - 3] == pytest.approx(sum(a == b for a, b in zip(words, words[lag:])) / len(words), abs=1e-5)


def test_attention_gradients():
    model = Q.QualityModel(3)
    rnd = np.random.default_rng(1)
    x = rnd.random((9, Q.FEATURES)).astype(np.float32) * 0.3
    text, y = np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 0, 1])

    def loss():
        starts = np.searchsorted(text, np.arange(4))
        z = model._forward(x.astype(np.float64), starts, np.diff(np.append(starts, 9)))["out"]
        return float((np.logaddexp(0, z) - y * z).mean())

    for name, g in model.gradients(x, text, y).items():
        flat, gf = model.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in {*rnd.integers(0, len(flat), 3).tolist(), int(np.abs(gf).argmax())}:
            old, out = flat[i], []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                out.append(loss())
            flat[i] = old
            assert (out[0] - out[1]) / 2e-3 == pytest.approx(gf[i], abs=2e-4)


def _auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = int((y == 1).sum())
    return (rank[y == 1].mean() - (n - 1) / 2) / (len(y) - n)


@pytest.mark.parametrize("op, label, least", [(Q.op5_quality, "quality", 0.98), (X.op7_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, op, label, least):
    got = op(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    fold = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert (got.held_out == fold).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= (0.3 if label == "quality" else 0.5))).all()
    held = got[fold]
    assert len(held) > 500 and _auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert (held.predicted == held[label]).mean() > least - 0.02


def test_language_held_out(spark):
    got = L.op2_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    fold = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)
    assert len(got) == 10000 and (got.held_out == fold).all()
    held = got[fold]
    assert (held.lang_pred == held.lang).mean() > 0.97
    sure = held[held.accepted]
    assert len(sure) > 0.9 * len(held) and (sure.lang_pred == sure.lang).mean() > 0.985


def _frame(spark):
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(ODD)] + [(None, "no key", "", 1.0), (4, "a", "", 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")


def test_odd_rows(spark):
    rows, df = _frame(spark)
    lang = L.LanguageModel(["de", "en"]).fit(["der die das", "the and of"] * 20, np.array([0, 1] * 20))
    got = L.identify(df, lang).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in range(4)] == ["und"] * 4 and all(by[i] in ("de", "en") for i in range(4, len(ODD)))
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in L.identify(df, L.train(df.where("false").withColumn("lang", df.text))).collect()} == {"und"}
    for model, score in ((Q.QualityModel().fit(["good text", "BAD!!"] * 20, np.array([1, 0] * 20)), Q.score_quality),
                         (X.ToxicityModel().fit(["good text", "you fool"] * 20, np.array([0, 1] * 20)), X.score_toxicity),
                         (Q.QualityModel().fit([], np.empty(0)), Q.score_quality),
                         (X.ToxicityModel().fit([], np.empty(0)), X.score_toxicity)):
        got = score(df, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        s = {r.doc_id: r.score for r in got}
        assert s[0] == s[1]
        assert score(df.limit(0), model).collect() == []


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 1), (4, None)], "doc_id long, quality int")
    texts, y = X.labelled_sample(docs, labels, "quality")
    want = {f"text {i}" for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert set(texts) == want and len(texts) == len(want) and len(y) == len(texts)
    assert len(X.labelled_sample(docs, labels, "quality", rows=7)[0]) == 7
    kept = Q.keep_good(docs, Q.QualityModel().fit([], np.empty(0)))
    assert kept.columns == docs.columns and kept.count() == 61


def test_rare_languages_are_learned_beside_a_large_one(spark):
    """Every language's pick is that from all rows, however many rows another language has."""
    def rows(lang, a, b):
        return spark.range(a, b).selectExpr("id doc_id", f"'{lang}' lang", f"concat('{lang} ', id) text")

    docs = rows("aa", 0, 30000).union(rows("bb", 50000, 50012)).union(rows("cc", 60000, 60003)).union(rows("cc", 60000, 60003))
    texts, langs = L.snippets(docs, rows=2, fold=(4, 9))
    ranked = docs.selectExpr("lang", "text", "xxhash64(doc_id) h").distinct().orderBy("h").collect()
    want = {x: sorted([r.text for r in ranked if r.lang == x][:2]) for x in ("aa", "bb", "cc")}
    assert {x: sorted(t for t, n in zip(texts, langs) if n == x) for x in set(langs)} == want
