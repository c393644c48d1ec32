"""Packing: token pieces against the plain tokenizer, the plan against best fit over single pieces."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from newslens.llm import packing as P


def _best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(size - n)
    return sorted(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 20, 64])
    lengths = [min(size, 1 + int(rnd.expovariate(4 / size))) for _ in range(rnd.randint(0, 400))]
    used, at = defaultdict(list), Counter()
    for length, lo, n, first, copies, base in P.best_fit_plan(Counter(lengths), size):
        assert at[length] == lo
        at[length] += n
        for i in range(n):
            used[first + i // copies].append((base + i % copies * length, length))
    assert at == Counter(lengths)
    for slots in used.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(size - sum(n for _, n in s) for s in used.values()) == _best_fit(lengths, size)


def _rows():
    rnd = random.Random(5)
    words = ["Don't", "it's", "für", "ÄÖ", "éx", "12", "a\tb", "#!?", "the", "<|endoftext|>", "x" * 90, "naïve b"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    texts += [None, "", " \n ", "line\n\nline two", "same text", "same text"]
    return [(i, t, 0, "clash") for i, t in enumerate(texts)] + [(None, "no key", 0, ""), (3, texts[3], 0, "")]


def test_pieces_and_slots(spark):
    tok = Tokenizer.from_file(P.tokenizer_path())
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string")
    got = P.pack_documents(df, size=32, keep_ids=True).collect()
    want = []
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, s // 32, s, ids[s:s + 32]) for s in range(0, len(ids), 32)]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, list(r.ids)) for r in got))) == sorted(map(str, want))
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for slots in used.values():
        assert [o for o, _ in sorted(slots)] == np.cumsum([0] + [n for _, n in sorted(slots)])[:-1].tolist()
        assert sum(n for _, n in slots) <= 32
    assert len(used) == len(_best_fit([r.length for r in got], 32))


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    t, texts = P.WordTokenizer(P.tokenizer_path()), ["one two three", "four five six one", "", "one " + "y" * 99, "ÉÀ Σας ΟΔΟΣ J\u030c I\u0307 İ \u212a \u212b ﬁ"]
    plain = Tokenizer.from_file(P.tokenizer_path())
    for _ in range(2):
        assert [np.frombuffer(t.encode(x), "<u4").tolist() for x in texts] == \
            [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_against_the_plain_tokenizer():
    t, plain, rnd = P.WordTokenizer(P.tokenizer_path()), Tokenizer.from_file(P.tokenizer_path()), random.Random(11)
    letters = "abcXYZéÀßñÖ0129.,!?$%&#|'\"-_()\\ıİſΣςéJ̌한가\u00a0\t\u3000½²ªµ\x1c"
    pieces = [*letters, *"  \nabcdst'"] * 3 + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "<|"]
    for _ in range(20000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        assert np.frombuffer(t.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
