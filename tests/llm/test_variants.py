"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newslens.llm import variants as V


def _near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(x) + 1 == len(y) and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def _brute(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def _vocabulary(rnd, n, letters="abé", longest=9):
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(n)}
    return {w: 7 ** rnd.randint(0, 5) + rnd.randint(0, 2) for w in words}


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=3, max_size=3)), st.sets(st.text("abc", min_size=4, max_size=4)), st.booleans())
def test_composition_accepts_each_pair_once(shorter, longer, at_end):
    got = [(x, y) for x, y, _ in V.one_edit_pairs(sorted(shorter), sorted(longer), at_end)]
    want = [(x, y) for x in shorter for y in shorter if x < y and _near(x, y)]
    want += [(x, y) for x in shorter for y in longer if _near(x, y) and (at_end or y[:-1] != x)]
    assert sorted(got) == sorted(want)


def test_acceptor_is_minimal():
    machine = V.Acceptor()
    machine.add(sorted(a + b + c for a in "xyz" for b in "ab" for c in "mn"))
    assert len(machine.arcs) == 4  # one state for every length that is left
    machine.add(sorted(a + c for a in "ab" for c in "mn"))
    assert len(machine.arcs) == 4  # shared with the other list


@pytest.mark.parametrize("block,chars", [(4096, 1 << 17), (3, 1 << 17), (4096, 8)])
def test_against_all_pairs(spark, block, chars):
    """Also with partitions so small that they are started again down to single code points."""
    rnd = random.Random(block + chars)
    counts = _vocabulary(rnd, 300)
    long = "ab" * 4000  # very long words, with edits at both ends and inside
    counts |= {w: 6 for w in (long, long + "a", "b" + long, long[:5000] + "z" + long[5000:], long[:-1] + "x", long[:100] + long[101:])}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert _rows(V.group_variants(df, block=block, chars=chars)) == _brute(counts)
    pairs = sorted(tuple(r) for r in V.near_pairs(df, block, chars).collect())
    assert pairs == sorted((x, y) for x in counts for y in counts if _near(x, y) and (len(x), x) < (len(y), y))


def test_a_prefix_that_most_words_share(spark):
    rnd = random.Random(4)
    counts = {"gemein" + "".join(rnd.choice("abcd") for _ in range(4)): rnd.choice([1, 9, 90]) for _ in range(200)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _rows(V.group_variants(df, block=20)) == _brute(counts)


def test_words_of_documents(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice(["Straße", "STRASSE", "École", "naïveté", "abcdef", "Abcdefg", "xyz12abcdef", "İstanbul", "ÀÉ×÷ßÿa", "kurz"])
                          for _ in range(200)) + rnd.choice(["", ".", "\nabcdef"])) for i in range(60)]
    texts += [(None, "abcdef " * 6), (3, None), (4, ""), texts[0], texts[0], (70, "Q" * 30000), *[(71, "q" * 30001)] * 5]
    want = Counter()
    for k, t in texts:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            if h % 7 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            want[r] += len(r) >= 6
    want = {w: n for w, n in want.items() if n >= 5}
    df = spark.createDataFrame([(k, t, "x", 0, "f") for k, t in texts], "doc_id long, text string, word string, n int, form string")
    assert {r.word: r.n for r in V.count_words(df.repartition(4), damage=7).collect()} == want
    assert _rows(V.group_variants(V.count_words(df, damage=7))) == _brute(want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert V.group_variants(V.count_words(none)).collect() == []
