"""Fingerprints: span hashes and extensions against plain comparison, neighbours against a sorted list."""

import hashlib
import random
from os.path import commonprefix

import numpy as np
import pytest

from newslens.llm import fingerprint as P
from newslens.llm.prefixhash import PrefixHashes


def _texts(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        body = " ".join("".join(rnd.choice("aeioubcdfé\U0001f600") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.choice([0, 1, 3, 30, 300])))
        out.append(body[:rnd.randint(0, len(body))])
    return out


def test_span_hashes_tell_spans_apart():
    texts = _texts(1, 12)
    h, joined, rnd = PrefixHashes(texts), "".join(texts), random.Random(2)
    spans = [sorted((rnd.randint(0, len(joined)), rnd.randint(0, len(joined)))) for _ in range(300)]
    spans += [(a, min(len(joined), a + 2)) for a in range(300)]
    a, b = map(np.array, zip(*spans))
    one = (h.spans(a, b, 0).astype(object) << 31) + h.spans(a, b, 1).astype(object)
    by = {}
    for (x, y), v in zip(spans, one):
        by.setdefault(joined[x:y], set()).add(v)
    assert all(len(v) == 1 for v in by.values()) and len({*one}) == len(by)


def test_extensions_and_equal_texts():
    x, y = _texts(3, 80), _texts(4, 80)
    y = [a[:len(a) // 2] + b if i % 3 else a for i, (a, b) in enumerate(zip(x, y))]
    got = PrefixHashes(x).extension(PrefixHashes(y))
    assert got.tolist() == [len(commonprefix([a, b])) for a, b in zip(x, y)]
    f = P.Fingerprints(x + x[::-1])
    by = {}
    for t, p in zip(x + x[::-1], f.text):
        by.setdefault(t, set()).add(p)
    assert all(len(v) == 1 for v in by.values()) and len({p for v in by.values() for p in v}) == len(by)


def test_likeness_estimates_the_common_share():
    rnd = random.Random(6)
    for n in (12, 40, 140, 800, 9000):
        text = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
        other = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
        f = P.Fingerprints([text, P.edited(text, other), other])
        near = P.likeness(f.text[0], f.text[1], f.sketches[0], f.sketches[1])
        far = P.likeness(f.text[0], f.text[2], f.sketches[0], f.sketches[2])
        assert 0.5 < near < 0.95 and far < 0.35


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_sorted_list(spark, ranges):
    rnd = random.Random(ranges)
    texts = _texts(9, 70) + [None, None, "", "same text here", "same text here"]
    ids = rnd.sample(range(-50, 500), len(texts))
    rows = [(i, t, "clash") for i, t in zip(ids, texts)]
    got = {r.doc_id: r for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
                                                       .repartition(5), ranges=ranges).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e, r = P.edited(t, after), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        f = P.Fingerprints([t, e, after])
        assert (r.fingerprint, r.edited_fingerprint) == (f.text[0], f.text[1])
        assert r.near_edited == P.likeness(f.text[0], f.text[1], f.sketches[0], f.sketches[1])
        assert r.near_next == P.likeness(f.text[0], f.text[2], f.sketches[0], f.sketches[2])
        assert (r.lce_edited, r.lce_next) == (len(commonprefix([t, e])), len(commonprefix([t, after])))


def test_small_and_odd_tables(spark):
    schema = "doc_id long, text string"
    assert P.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []
    one = P.fingerprint_documents(spark.createDataFrame([(5, "abcdefgh")], schema)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(1, "x"), (1, "x"), (None, "null key one"), (None, None), (2, "y" * 20)]
    assert P.fingerprint_documents(spark.createDataFrame(rows, schema)).count() == 5
    words = spark.createDataFrame([("b", "second"), ("a", "first!!!")], "name string, body string")
    got = P.fingerprint_documents(words, "name", "body").orderBy("name").collect()
    assert got[0].edited_sha256 == hashlib.sha256(b"first!se").hexdigest()


def test_neighbours_of_very_different_lengths_are_compared(spark):
    rnd = random.Random(12)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789éß ") for _ in range(4000))
    other = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(400))
    rows = [(1, text[60:187]), (2, text[:260]), (3, text[100:115]), (4, text[95:130]), (5, other), (6, text[:20]), (7, "x"), (8, text[:300])]
    got = {r.doc_id: r for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def share(a, b, w):
        p, q = ([t[i:i + w] for i in range(len(t) - w + 1)] for t in (a, b))
        return 2 * sum(min(p.count(x), q.count(x)) for x in {*p}) / (len(p) + len(q))

    by = dict(rows)
    assert got[1].near_next == pytest.approx(share(by[1], by[2], 5), abs=0.2) and got[1].near_next > 0.4
    assert got[3].near_next == pytest.approx(share(by[3], by[4], 2), abs=0.2) and got[3].near_next > 0.3
    assert got[2].near_next > 0 and got[4].near_next == got[5].near_next == 0
    assert got[6].near_next == got[7].near_next == 0  # a single character has no span
    f = P.Fingerprints([t for _, t in rows])
    assert [got[d].fingerprint for d, _ in rows] == f.text
