"""Decontamination against a full edit-distance search of every window in every document."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from newslens.llm import decontam as D


def _normal(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text or "").split())


def _within(window, text, k):
    """Whether some stretch of ``text`` is within ``k`` edits of ``window``: of k + 1 pieces of the window one is whole."""
    n = max(1, (len(window) - k) // (k + 1))
    if not any(window[i:i + n] in text for i in range(len(window) - n + 1)):
        return False
    row = np.zeros(len(text) + 1, int)
    letters = np.array(list(text))
    for i, ch in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (letters != ch), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min()) <= k


def _windows(item, size=D.WINDOW, stride=D.STRIDE):
    return [item[s:s + size] for s in sorted({*range(0, max(1, len(item) - size + 1), stride), max(0, len(item) - size)})]


def _edit(rnd, text, n):
    c = list(text)
    for _ in range(n):
        p = rnd.randrange(len(c))
        what = rnd.random()
        if what < 0.4:
            c[p] = rnd.choice("abcxyz")
        elif what < 0.7:
            c.insert(p, rnd.choice("abc xyz"))
        else:
            del c[p]
    return "".join(c)


def _cases():
    rnd = random.Random(4)
    syllables = "th er tion an ing on ble re he st nd ou la de que ción".split()

    def prose(n):
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    items = [(i, prose(rnd.randint(5, 70))) for i in range(12)] + [(90, None), (91, ""), (92, "Ab"), (93, "short one, ok?")]
    docs = []
    for i in range(90):
        body = prose(rnd.randint(0, 120))
        at = rnd.randint(0, len(body))
        part = rnd.choice(items[:12])[1]
        a = rnd.randint(0, len(part) // 2)
        part = _edit(rnd, part[a:a + rnd.randint(90, 400)] or "x", rnd.randint(0, 16))
        docs.append((i, body[:at] + rnd.choice([" ", "\n", ". ", "X"]) + part.upper() + " " + body[at:] if i % 3 else body))
    return items, docs + [(200, None), (201, ""), (202, "Short  one -- OK"), (203, items[0][1] + "  " + items[1][1]), (204, items[2][1] * 3)]


def test_against_full_search(spark):
    items, docs = _cases()
    want = set()
    for d, t in docs:
        for i, b in items:
            b, t_ = _normal(b), _normal(t)
            if len(b) >= D.Q and any(_within(w, t_, D.edit_budget(len(w))) for w in _windows(b)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    assert len(want) > 30 and {(r.doc_id, r.item_id) for r in rows} == want
    text = dict(docs)
    for r in rows:
        assert 0 <= r.start < r.end <= len(text[r.doc_id])
    many = D.contaminated(df, bench, block_chars=600).collect()
    assert sorted(map(str, many)) == sorted(map(str, rows))
    clean = D.without_contamination(df, bench).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in want}


def test_exact_regions():
    item = "The quick brown fox, " + ", ".join(f"N{i * i * 7919 % 10007}" for i in range(40)) + "."
    index = D.Index([(7, item)])
    text = "é " * 40 + item + "zz " * 30
    (_, s, e, edits), = D.scan([text], index)[0]
    assert (s, edits) == (80, 0) and _normal(text[s:e]) == _normal(item)
    assert D.scan(["x " * 50, "", text], index)[:2] == [[], []]


def test_hashes_and_budget():
    c = np.array([ord(x) for x in "abcabcabcdabc"], np.uint32)
    for q in (1, 2, 3, 5, 10):
        h = D.qgram_hashes(c, q)
        grams = [bytes(c[i:i + q]) for i in range(len(c) - q + 1)]
        seen = defaultdict(set)
        for g, x in zip(grams, h.tolist()):
            seen[g].add(x)
        assert len(h) == len(grams) and all(len(v) == 1 for v in seen.values()) and len({*h.tolist()}) == len(seen)
    assert all(m - D.Q + 1 - D.edit_budget(m) * D.Q >= 1 for m in range(D.Q, 400))


def test_nothing_to_compare(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (1, "a" * 300), (None, "a" * 300)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).collect() == [] and D.without_contamination(docs, none).count() == 3
    item = spark.createDataFrame([("x", "a" * 120), ("x", "a" * 120)], "item_id string, text string")
    assert sorted(str(r.doc_id) for r in D.contaminated(docs, item).collect()) == sorted(["1", "1", "None"] * 2)
    assert D.contaminated(docs.limit(0), item).collect() == []


def test_every_start_is_a_window():
    rnd = random.Random(8)
    words = "th er tion an ing on ble re he st nd ou la de que".split()

    def prose(n):
        return " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    def least(item, text):
        """Fewest edits of any 100-character window, all starts in step."""
        starts = np.arange(len(item) - 99)
        item, letters = np.array(list(item)), np.array(list(text))
        row, cols = np.zeros((len(starts), len(letters) + 1), int), np.arange(len(letters) + 1)
        for i in range(100):
            new = np.full_like(row, i + 1)
            new[:, 1:] = np.minimum(row[:, :-1] + (letters != item[starts + i][:, None]), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - cols, 1) + cols
        return int(row.min())

    item = _normal(prose(60))
    index = D.Index([(3, item)])
    for a in range(len(item) - 99):  # a verbatim stretch of a window's length, wherever it starts
        text = "zz " * 20 + "[" + item[a:a + 100].strip() + "] " + "yy " * 20
        (_, s, e, edits), = D.scan([text], index)[0]
        assert 0 <= s <= 61 + D.edit_budget(100) and e - s >= 92 and edits <= 8
    found = 0
    for _ in range(120):
        a, n = rnd.randrange(len(item) - 130), rnd.randint(95, 135)
        text = _normal(prose(9) + " " + _edit(rnd, item[a:a + n], rnd.randint(0, 14)) + " " + prose(9))
        want = least(item, text) <= D.edit_budget(100)
        found += want
        assert bool(D.scan([text], index)[0]) == want
        assert [bool(x) for x in D.scan(["q", text[:40], text, item[:90]], index)] == [False, False, want, False]
    assert 30 < found < 110


def _found(text, item):
    """Whether the normal forms match by the rule, and the region's first and last character if it is exact."""
    text, item = _normal(text), _normal(item)
    return any(_within(w, text, D.edit_budget(len(w))) for w in set(_windows(item)))


@pytest.mark.parametrize("hits", [1 << 19, 300, 1])
def test_repetitions_and_shared_lines(monkeypatch, hits):
    """The same regions whether hits are held at once, in stretches, or item by item, with repetitions shortened (in a
    repetition several alignments of a window are equally good: ends may differ by a few characters)."""
    line = "all rights reserved by the owners of this work"
    items = [(1, "0" * 260), (2, "0 1 " * 50), (3, "ab" * 90), (4, "0" * 30 + line), (5, line + " and " + line + " xyz"), (6, line),
             (7, "q" + "0" * 130 + "w")]
    texts = ["0" * 3000, "0, 1; " * 400, "x" + "ab" * 500 + "y " + "0" * 90, line + ". " + line, "0" * 99, "q" + "0" * 700 + "w",
             "q" + "0" * 130 + "w", ("0" * 20 + "\n") * 60, "1 0 " * 23, "ba" * 400 + line + "0" * 400]
    monkeypatch.setattr(D, "HITS", 1 << 40)
    whole = D.scan(texts, D.Index(items))
    assert {(d, items[w][0]) for d, ms in enumerate(whole) for w, *_ in ms} == \
        {(d, i) for d, t in enumerate(texts) for i, b in items if _found(t, b)}
    monkeypatch.setattr(D, "HITS", hits)
    got = D.scan(texts, D.Index(items))
    for x, y in zip(map(sorted, got), map(sorted, whole), strict=True):
        assert [m[0] for m in x] == [m[0] for m in y]
        assert all(abs(a - b) <= 3 * D.edit_budget(100) for m, n in zip(x, y) for a, b in zip(m[1:3], n[1:3]))


def test_a_million_equal_characters(monkeypatch):
    tracemalloc.start()
    (w, s, e, edits), = D.scan(["0" * 10**6], D.Index([(1, "0" * 10**4)]))[0]
    assert (w, s, edits) == (0, 0, 0) and e > 10**6 - 10 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_short_items_stand_between_word_borders():
    index = D.Index([(1, "Two words"), (2, "cat"), (3, "!?"), (4, "cat"), (5, "日本")])
    got = D.scan(["a cat, two  WORDS.", "concat cats", "CAT", "(日本) 日本語", ""], index)
    assert [sorted((index.ids[w], s, e) for w, s, e, _ in ms) for ms in got] == \
        [[(1, 7, 17), (2, 2, 5), (4, 2, 5)], [], [(2, 0, 3), (4, 0, 3)], [(5, 1, 3)], []]


def test_clashing_key_names(spark):
    docs = spark.createDataFrame([(1, "a cat", 5)], "id long, text string, start int")
    bench = spark.createDataFrame([(9, "cat")], "id long, text string")
    assert [r.asDict() for r in D.contaminated(docs, bench, key="id", item="id").collect()] == \
        [{"id": 1, "id_": 9, "start": 2, "end": 5, "edits": 0}]
    assert D.contaminated(docs, bench, key="start", item="id").columns == ["start", "id", "start_", "end", "edits"]


def test_long_chains_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHAIN", 2)
    items = [(i, f"item number {i} " + "xyzuvw"[i] * 40) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in items] + [(99, "clean text of no item at all")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [r.doc_id for r in D.without_contamination(docs, bench, block_chars=100).collect()] == [99]
