"""Phrase collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from newslens.llm import collocations as C


def _counts(docs):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def _brute(docs, support, top):
    f, n = _counts(docs)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if " " in p and a >= support}
        dropped = set()
        for p, a in cand.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i:i + k])
                    if 100 * a >= 80 * c[q]:
                        dropped.add(q)
        rows = []
        for p, a in cand.items():
            w = p.split(" ")
            s, _, l, r = min((2000000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k, c[" ".join(w[:k])],
                              c[" ".join(w[k:])]) for k in range(1, len(w)))
            if p not in dropped:
                rows.append((-s, -a, p.encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def _docs(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "äpfel", "Ünder", "x y", "İ", "\x1c", "a'b", "日本"] + [f"w{i}" for i in range(30)]
    docs = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += ["one", "two", "three", "four", "five"] if rnd.random() < 0.04 else [rnd.choice(vocabulary)]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ; ", "!?", "\x0b", "\r\n"]) for w in words)
        docs.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), (None, None), ("fr", ""), ("xx", " .,. \t")] + docs[:7] * 5


def _frame(spark, docs):
    rows = [(i if i % 11 else None, t, g, 1, "z") for i, (g, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k int, phrase string").repartition(3)


@pytest.mark.parametrize("part,support,chunk,bits", [(4, 6, 8 << 20, 1 << 20), (2, 30, 300, 1 << 15), (10**6, 9, 64, 1 << 22)])
def test_against_plain_counts(spark, part, support, chunk, bits):
    """Also with slices inside texts, with a bitmap so small that it holds much by chance, and with a sample that
    proposes nothing, so that everything comes by expansion passes."""
    docs = _docs(part)
    df = _frame(spark, docs)
    got = sorted(tuple(r) for r in C.collocations(df, support, 40, part=part, bits=bits, chunk=chunk).collect())
    assert got == _brute(docs, support, 40) and got
    frequent = {(r.lang, r.phrase): r.f for r in C.frequent_phrases(df, support, part=part, bits=bits, chunk=chunk).collect()}
    f, n = _counts(docs)
    want = {(g, p): a for g, c in f.items() for p, a in c.items() if a >= support} | {(g, ""): x for g, x in n.items() if x}
    assert frequent == want


def test_empty_table(spark):
    assert C.collocations(_frame(spark, [])).collect() == []


def test_slices_lose_and_repeat_nothing():
    rnd = random.Random(2)
    for _ in range(60):
        plain = b"".join(rnd.choice([b"a", b"bb", b" ", b".", b"c" * 30]) for _ in range(rnd.randint(0, 90)))
        whole = C.words(plain)
        got = [w for c, t in C.slices(plain, rnd.randint(1, 40)) for w in C.words(t)[c:]]
        assert got == whole
        ids, names = C.numbered(plain)
        assert [names[i] for i in ids] == whole


def test_a_bit_of_the_bitmap_is_the_hash(spark):
    h = np.random.default_rng(1).integers(0, 1 << 64, 50, np.uint64)
    held = C.bitmap(spark.createDataFrame([(int(x),) for x in h[:25].view(np.int64)], "h long"), 1 << 20)
    assert held.holds(h).tolist() == [True] * 25 + [False] * 25


def test_hashes_depend_on_language_words_and_length():
    words = C.Words()
    seen = set()
    for lang in (b"en", b"de"):
        for t in ([b"a", b"b"], [b"b", b"a"], [b"ab"], [b"a", b".", b"b"]):
            for k, h, there in C.phrase_hashes(lang, np.array([words[w] for w in t], np.uint64), 3):
                assert all(int(x) & 3 == k - 1 for x in h)
                assert there.tolist() == [b"." not in t[i:i + k] for i in range(len(t) - k + 1)]
                seen |= {int(x) for x, y in zip(h, there) if y}
    assert len(seen) == 2 * 5  # a, b, ab, a b, b a


def test_products_beyond_64_bits(spark):
    a = 9 * 10**17
    rows = [("en", "x", 1, 2 * a), ("en", "y", 1, 2 * a + 1), ("en", "x y", 2, a), ("en", "", 0, 5 * a)]
    got = C.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).collect()
    assert [(r.phrase, r.score) for r in got] == [("x y", 2000000 * a // (4 * a + 1))]


def test_sql_on_a_small_table(spark):
    docs = _docs(8, 900)
    got = sorted(tuple(r) for r in C.collocations(_frame(spark, docs)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, g, t) for i, (g, t) in enumerate(docs)])
    assert got == sorted(con.execute(C.OP13_SQL).fetchall()) and got
