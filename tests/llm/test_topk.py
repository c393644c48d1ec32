"""Exact top-k by pivot elimination against brute force over all pairs."""

import random

import numpy as np
import pytest

from newslens.llm import topk as K

SCHEMA = "score string, vec_id long, embedding array<double>, query_id int"  # columns that clash with the result's


def _brute(rows, k, scale=1.0):
    rows = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows
            if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    first = {}
    for i, v in rows:
        if i % 50 == 0:
            first[i] = min(v, first.get(i, v))
    out = []
    for q, v in first.items():
        got = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(got)]
    return sorted(out)


def _run(spark, rows, k, **more):
    df = spark.createDataFrame([("x", i, v, 7) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in K.top_k(df, lambda i: i % 50 == 0, k, **more).collect())


@pytest.mark.parametrize("tile,query_bytes", [(256, 8 << 20), (3, 200)])
def test_against_brute_force(spark, monkeypatch, tile, query_bytes):
    monkeypatch.setattr(K, "TILE", tile)
    monkeypatch.setattr(K, "QUERY_BYTES", query_bytes)  # several passes
    rnd = np.random.default_rng(tile)
    centres = rnd.normal(0, 3, (4, 8))
    rows = [(i, (centres[i % 4] + rnd.normal(0, 0.5, 8)).tolist()) for i in range(700)]
    assert _run(spark, rows, 5, scale=16.0) == _brute(rows, 5, 16.0)


def test_ties_copies_and_repeated_ids(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(0, 120), [float(rnd.randint(-1, 1)) for _ in range(3)]) for _ in range(500)]
    assert _run(spark, rows, 5) == _brute(rows, 5)


def test_odd_rows_huge_components_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [nan, 1.0]), (100, None), (2, [None, 1.0]), (None, [1.0, 1.0]),
            (3, [inf, 0.0]), (150, [2.0, 2.0, 2.0]), (4, [1.0, 1.0, 0.0]), (200, []), (5, []), (250, [1e17, 3.0]),
            (6, [1e30, 1.0]), (7, [-1e17, 5.0]), (8, [2.5, 2.5]), (300, [9.0] * 4)]
    assert _run(spark, rows, 3) == _brute(rows, 3)
    assert _run(spark, [], 3) == []
    assert _run(spark, [(0, [1.0])], 3) == []


def test_no_cap_is_below_its_product():
    rnd = np.random.default_rng(5)
    for size in (2.0, 300.0, 1e6):
        x = np.floor(rnd.normal(0, size, (200, 16)))
        p = x[K.choose_pivots(x, 12)]
        d = K._distances(x, p)
        n = (x * x).sum(axis=1)
        assert (K.caps(n, d, n, d) >= x @ x.T).all()


def test_elimination_spares_products():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(0, 400, (10, 16))
    x = np.floor(centres[np.arange(2000) % 10] + rnd.normal(0, 10, (2000, 16)))
    p = x[K.choose_pivots(x, 32)]
    q, ids = x[:40], np.arange(2000)
    best = K._Best(ids[:40], 5, np.full(40, -np.inf))
    spent = K._evaluate(best, q, K._distances(q, p), ids, x, K._distances(x, p))
    assert spent < 0.2 * len(q) * len(x)
    top = [[i for _, i in sorted((-int(x[j] @ v), j) for j in range(2000) if j != n)[:5]] for n, v in enumerate(q)]
    assert [r.tolist() for r in best.row] == top
