"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from newslens.llm import simhash as S
from newslens.llm.components import connected


def _plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint_against_plain(monkeypatch):
    texts = [None, "", " \t\n", "One", "a B", "a b c", "ÄÖ x y z  z z\tq", "w " * 500, "the Cat sat " * 7 + "İ K"]
    assert [S.fingerprint(t) for t in texts] == [_plain(t) for t in texts]
    monkeypatch.setattr(S, "BLOCK", 4)
    assert [S.fingerprint(t) for t in texts] == [_plain(t) for t in texts]


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks(range(64), 3)
    rnd = random.Random(1)
    for _ in range(2000):
        d = sum(1 << p for p in rnd.sample(range(64), 3))
        assert any(not d & m for m in masks)
    level = S.finer_masks(masks, 3)
    assert all(m & f == m and m != f for m, fs in level.items() for f in fs)
    third = S.finer_masks([f for fs in level.values() for f in fs], 3)
    fourth = S.finer_masks([f for fs in third.values() for f in fs], 3)
    assert not S.finer_masks([f for fs in fourth.values() for f in fs], 3)  # then at most 256 values are possible


@pytest.mark.parametrize("bucket", [256, 16])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rnd = random.Random(bucket)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:12]:
        for _ in range(15):
            base ^= sum(1 << p for p in rnd.sample(range(64), rnd.randint(1, 4)))
            fps.add(base)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ sum(1 << p for p in rnd.sample(range(14), rnd.randint(0, 7))) for _ in range(900)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = S.links(df, 3, bucket).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
    at = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(fps)}
    root = {r.node: r.root for r in connected(S.links(df, 3, bucket)).collect()}
    got = {}
    for x, i in at.items():
        got.setdefault(root.get(x, x), set()).add(i)
    want = {}
    for i, r in enumerate(_components(fps)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    texts += [texts[0]] * 5 + [t + " tail" for t in texts[:20]] + [None, "", "\n"]
    rows = [(100 - i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[3], "x", "y"), (100, texts[0], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = S.near_duplicates(df).collect()
    fps = [_plain(r[1]) for r in rows]
    comp = _components(fps)
    low = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None)
           for c in set(comp)}
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == \
        sorted(map(str, ((rows[i][0], f"{fps[i]:016x}", low[comp[i]]) for i in range(len(rows)))))


def test_one_of_each_component_stays(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "other words here now"), (None, "alone text of none"),
            (None, "alone text of none"), (7, None), (8, ""), (9, "third words under nine")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _k string, _n int")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, [
        (3, "a b c d"), (9, "other words here now"), (None, "alone text of none"), (7, None), (9, "third words under nine")]))


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 30)}
