"""Density topics and their graph steps against plain implementations."""

import numpy as np
import pytest

from newslens.operators import density as D
from newslens.operators.graph import components, cut_round, spanning_forest


class _Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _frame(spark, x, keys=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if keys is None else keys, x)],
                                 "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("n,m", [(300, 200), (200, 0)])
def test_components_and_forest(spark, n, m):
    rnd = np.random.default_rng(m)
    edges = [(int(a), int(b), float(rnd.integers(0, 9))) for a, b in rnd.integers(0, n, (m, 2))]
    edges += [(i, i + 1, 1.0) for i in range(n, n + 60)] + [(n + 200, i, 2.0) for i in range(n + 100, n + 190)] + [(5, 5, 0.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double").repartition(3)
    union = _Union()
    for a, b, _ in edges:
        if a != b:
            union.join(a, b)
    assert sorted(map(tuple, components(df).collect())) == sorted((x, union.find(x)) for x in union)
    tree, want = _Union(), []
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if tree.join(a, b):
            want.append((a, b, w))
    assert sorted(map(tuple, spanning_forest(df).collect())) == sorted(want)


def test_rounds_of_joins_keep_a_measured_size(spark):
    """Guessed sizes of joins multiply: after these rounds they would have hundreds of digits."""
    df = cut_round(spark.range(50).withColumnRenamed("id", "a"))
    for _ in range(4):
        df = cut_round(df.join(df.select("a"), "a").join(df.select("a"), "a"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10_000 and df.count() == 50


def test_pairs_within_a_radius(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 50)
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(0, 1, (300, 4)), np.repeat(rnd.normal(0, 1, (3, 4)), 40, 0)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.7)) if i != j)
    assert sorted((r.id, r.other) for r in D.radius_pairs(_frame(spark, x), 0.7, pivots=12).collect()) == want and len(want) > 3000


def test_core_clusters_with_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, [1.0, 0.0]), (9, [9.0, 9.0]), (4, None), (5, [float("nan"), 0.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 3, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, n_near string")
    got = sorted(tuple(r) for r in D.core_clusters(df, 0.6, 2).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (9, 0, -1)]
    assert D.core_clusters(df.limit(0), 0.6, 2).collect() == []


def test_recall_of_the_projection_tables(spark):
    """On clustered points and on points without any structure, the hardest case."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 1, (40, 24))
    for x in (centres[rnd.integers(0, 40, 3000)] + rnd.normal(0, 0.2, (3000, 24)), rnd.normal(0, 1, (2000, 24))):
        d = ((x[:, None, :8] - x[None, :, :8]) ** 2).sum(-1) + ((x[:, None, 8:16] - x[None, :, 8:16]) ** 2).sum(-1) \
            + ((x[:, None, 16:] - x[None, :, 16:]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        true = np.argsort(d, 1)[:, :5]
        got = {}
        for r in D.near_neighbours(_frame(spark, x), 5).collect():
            got.setdefault(r.id, set()).add(r.other)
        recall = sum(len(got[i] & set(t.tolist())) for i, t in enumerate(true)) / true.size
        assert recall >= 0.95, recall


def test_copies_do_not_fill_a_bucket(spark):
    x = np.concatenate([np.zeros((900, 3)) + 0.5, np.random.default_rng(1).normal(0, 1, (100, 3))])
    rows = D.near_neighbours(_frame(spark, x), 3, tables=2, bucket=16).collect()
    assert {r.id for r in rows if r.id < 900 and r.d == 0} == set(range(900))


def _stable(edges, min_size, levels):
    """The same rule on Python sets."""
    ws = sorted(w for *_, w in edges if w > 0)
    cuts = sorted({ws[max(0, -(-(i + 1) * len(ws) // levels) - 1)] for i in range(levels)} | ({0.0} if any(w == 0 for *_, w in edges) else set()))
    inverse = [1 / c if c else 2 / cuts[1] for c in cuts]
    below, chains = [], []
    for i, c in enumerate(cuts):
        union = _Union()
        for a, b, w in edges:
            if w <= c:
                union.join(a, b)
        groups = {}
        for x in union:
            groups.setdefault(union.find(x), set()).add(x)
        now = []
        for g in groups.values():
            if len(g) < min_size:
                continue
            inside = [ch for ch in below if ch["nodes"] <= g]
            ch = inside[0] if len(inside) == 1 else {"own": 0.0, "inner": sum(max(k["own"], k["inner"]) for k in inside)}
            if len(inside) != 1:
                chains.append(ch)
            ch.update(nodes=g, level=i)
            ch["own"] += len(g) * (inverse[i] - inverse[i + 1] if i + 1 < len(cuts) else 0)
            now.append(ch)
        below = now
    out = {}
    for ch in sorted(chains, key=lambda c: c["level"]):
        if ch["own"] >= ch["inner"]:
            out |= {x: min(ch["nodes"]) for x in ch["nodes"]}
    return out


def test_stable_clusters_against_sets(spark):
    rnd = np.random.default_rng(0)
    x = np.concatenate([c + rnd.normal(0, s, (n, 2)) for c, s, n in (((0, 0), 0.2, 40), ((3, 0), 0.3, 30), ((3.2, 1.5), 0.2, 25), ((9, 9), 2, 20))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    edges = [(int(i), int(j), round(float(d[i, j]), 3)) for i in range(len(x)) for j in range(i)]
    union = _Union()
    forest = [(min(a, b), max(a, b), w) for w, a, b in sorted((w, a, b) for a, b, w in edges) if union.join(a, b)]
    df = spark.createDataFrame(forest, "a long, b long, w double")
    got = {r.node: r.cluster for r in D.stable_clusters(df, 8, 6).collect()}
    assert got == _stable(forest, 8, 6) and len(set(got.values())) >= 3


def test_dense_regions_and_outliers(spark):
    rnd = np.random.default_rng(5)
    truth = np.repeat([0, 1, -1], [60, 60, 15])
    x = np.array([[0, 0, 0], [4, 0, 0], [0, 0, 0]])[truth] + rnd.normal(0, 0.3, (135, 3))
    x[truth == -1] = rnd.uniform(-20, 20, (15, 3))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, None, 0), (None, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, topic int")
    got = {r.vec_id: r.topic for r in D.density_topics(df).collect()}
    assert len(got) == 136 and got[500] == D.OUTLIER
    for t, first in ((0, 0), (1, 60)):
        assert sum(got[i] == first for i in np.flatnonzero(truth == t)) > 54
    assert sum(got[i] == D.OUTLIER for i in np.flatnonzero(truth == -1)) >= 8
