"""Core clusters against brute force, with parts and blocks of a few points, and without a list of all pairs."""

import numpy as np
import pytest

from newslens.operators import density as D


def _brute(keys, x, radius, min_points):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = (d <= radius) & (keys[:, None] != keys)
    n = {int(k): int(near[keys == k].sum()) for k in keys}  # a key's rows count together
    core = {k for k in n if n[k] + 1 >= min_points}
    root = {k: k for k in core}
    while True:
        before = dict(root)
        for i, j in zip(*np.nonzero(near)):
            a, b = int(keys[i]), int(keys[j])
            if a in core and b in core:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return sorted((int(k), n[int(k)], root.get(int(k), -1)) for k in keys)


def _points(kind):
    rnd = np.random.default_rng(5)
    if kind == "random":
        return np.arange(300), rnd.normal(0, 1, (300, 8)), 2.2
    if kind == "far from zero":  # single precision does not tell these apart
        return np.arange(200), 1e5 + rnd.normal(0, 1, (200, 3)), 0.5
    if kind == "grid":  # many distances equal the radius
        return np.arange(225), np.array([(a, b) for a in range(15) for b in range(15)], float) * 0.5, 0.5
    x = np.concatenate([c + rnd.normal(0, 0.2, (60, 4)) for c in rnd.normal(0, 3, (5, 4))] + [np.zeros((120, 4))])
    keys = rnd.permutation(len(x))
    return (keys // 2 if kind == "shared keys" else keys), x, 0.35


@pytest.mark.parametrize("kind", ["random", "far from zero", "grid", "clusters and copies", "shared keys"])
def test_core_clusters_without_a_list_of_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(D, "CELL", 20)
    monkeypatch.setattr(D, "PART", 60)
    monkeypatch.setattr(D, "PIVOTS", 9)
    monkeypatch.setattr(D, "radius_pairs", None)  # as many rows as pairs
    keys, x, radius = _points(kind)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in D.core_clusters(df, radius, 4).collect())
    want = _brute(keys, x, radius, 4)
    assert got == want and (kind == "shared keys" or len({c for *_, c in want}) > 1)


def test_what_leaves_the_tasks_grows_with_points_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 50)
    monkeypatch.setattr(D, "PART", 100)
    out, meet = [], D._meet
    monkeypatch.setattr(D, "_meet", lambda *a: out.append((a[3].__name__, meet(*a))) or out[-1][1])
    df = spark.createDataFrame([(i, [float(i % 7) / 100, 0.0]) for i in range(600)], "vec_id long, embedding array<double>")
    assert {tuple(r)[1:] for r in D.core_clusters(df, 1.0, 5).collect()} == {(599, 0)}
    rows = {name: d.count() for name, d in out}
    parts = 6 + 7
    assert rows["counts"] <= 600 * (parts + 1) and rows["inside"] == 600 and rows["across"] <= parts ** 2
