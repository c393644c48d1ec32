"""Exact top-k inner products: pivot-table elimination.

The pivot table holds every vector with its distances to a few pivots. For a query ``q`` and a row ``x`` each pivot ``p``
bounds their distance from below by ``|d(q, p) - d(x, p)|``; the greatest of these bounds caps the inner product, as
``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``. A task evaluates a block's rows in the order of their caps, highest first, and stops
at the first cap that is below the k-th best product found: nothing behind it can enter the result. Pivots are rows of the
table, so their own products give every query a first k-th best before any block is read.

Components are whole numbers, and products are computed exactly: in doubles as long as no sum can reach 2^53, otherwise
(rows with very large components) in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import cut_lineage, take_ids
from newslens.sources.tables import table

#: Pivots for each vector length, and the rows (smallest hashes of the key) that they are picked from.
PIVOTS, PIVOT_SAMPLE = 32, 1024
#: Bytes of query vectors that are collected and broadcast at once. More queries mean more passes over the table.
QUERY_BYTES = 8 << 20
#: Rows and queries whose caps are held at once in a task, and rows evaluated before the first look at the k-th best (twice
#: as many before each further one).
BLOCK_ROWS, TILE, STEP = 2048, 256, 32
_LONG = 1 << 63


def usable(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): key and components ``floor(scale * x)`` as doubles of the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine) \
        .select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _by_length(col: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, whole-number matrix) of the rows of every length."""
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = np.floor(col.flatten().to_numpy(zero_copy_only=False)), np.concatenate(([0], np.cumsum(sizes)))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def _limit(n: int) -> float:
    """Components up to this make every product of vectors of length ``n``, and every squared distance, exact in doubles."""
    return float(np.sqrt(2.0 ** 51 / max(1, n)))


def _normal(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0) <= _limit(x.shape[1])


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Positions of up to ``n`` rows of ``x`` by farthest-first traversal from its first row."""
    picked = []
    far = np.full(len(x), np.inf)
    while len(picked) < min(n, len(x)) and far.max(initial=0) > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked, np.int64)


def _pivots(vectors: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the pivots for each vector length that the sample holds."""
    rows = take_ids(vectors, "id", PIVOT_SAMPLE).collect()
    col, out = pa.array([r["v"] for r in rows], pa.list_(pa.float64())), {}
    ids = np.array([r["id"] for r in rows], np.int64)
    for at, x in _by_length(col) if rows else ():
        at, x = at[_normal(x)], x[_normal(x)]
        picked = choose_pivots(x, n)
        out[x.shape[1]] = ids[at][picked], x[picked]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, from exact squares."""
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0))


def pivot_table(vectors: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, v, d): every vector with its distances to the pivots of its length (none for a row with components beyond
    the exact range, or of a length without pivots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column(1)):
                points = pivots[x.shape[1]][1] if x.shape[1] in pivots else x[:0]
                normal = _normal(x)
                for part, d in ((normal, _distances(x[normal], points)), (~normal, x[~normal][:, :0])):
                    rows = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                            for m in (x[part], d)]
                    ids = b.column(0).take(pa.array(at[part]))
                    yield pa.RecordBatch.from_arrays([ids, *rows], names=["id", "v", "d"])

    return vectors.mapInArrow(run, "id long, v array<double>, d array<double>")


class _Best:
    """The best ``k`` products of each query so far, and the product that a row must reach to matter."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.score = [np.empty(0)] * len(ids)
        self.row = [np.empty(0, np.int64)] * len(ids)

    def offer(self, i: int, score: np.ndarray, row: np.ndarray) -> None:
        good = score >= self.floor[i]
        if not good.any():
            return
        score, row = np.concatenate((self.score[i], score[good])), np.concatenate((self.row[i], row[good]))
        top = np.lexsort((row, -score))[:self.k]
        self.score[i], self.row[i] = score[top], row[top]
        if len(top) == self.k:
            self.floor[i] = max(self.floor[i], score[top[-1]])


def caps(nq: np.ndarray, dq: np.ndarray, nx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Upper bounds of all inner products of queries and rows, given squared norms and pivot distances. Rounding is
    covered: no bound is below its product."""
    low = np.zeros((len(nq), len(nx)))
    for j in range(dq.shape[1]):
        np.maximum(low, np.abs(dq[:, j, None] - dx[:, j]), out=low)
    both = nq[:, None] + nx
    low = np.maximum(low - 1e-12 * np.sqrt(both * 4), 0)
    return (both - low * low) / 2 + 1e-9 * both + 0.5


def _evaluate(best: _Best, q: np.ndarray, dq: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray) -> int:
    """Offer every query the rows that can matter to it, in the order of their caps; returns how many products that took."""
    nq, nx, spent = (q * q).sum(axis=1), (x * x).sum(axis=1), 0
    for a in range(0, len(q), TILE):
        cap = caps(nq[a:a + TILE], dq[a:a + TILE], nx, dx)
        cap[best.ids[a:a + TILE, None] == ids] = -np.inf  # a query's own row
        for i in range(a, min(a + TILE, len(q))):
            c = cap[i - a]
            left = np.flatnonzero((c >= best.floor[i]) & (c > -np.inf))
            left = left[np.argsort(-c[left], kind="stable")]
            s, step = 0, STEP
            while s < len(left) and c[left[s]] >= best.floor[i]:
                some = left[s:s + step]
                best.offer(i, x[some] @ q[i], ids[some])
                spent += len(some)
                s, step = s + step, 2 * step
    return spent


def _exactly(ids: np.ndarray, q: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, row, product) of each query's best ``k`` rows, in Python's integers."""
    whole = [[int(c) for c in r] for r in x.tolist()]
    for qid, v in zip(ids.tolist(), q.tolist()):
        v = [int(c) for c in v]
        got = ((sum(a * b for a, b in zip(v, r)), i) for i, r in zip(rows.tolist(), whole) if i != qid)
        for s, i in sorted(got, key=lambda t: (-t[0], t[1]))[:k]:
            yield qid, i, max(-_LONG, min(_LONG - 1, s))


def _search(rows: DataFrame, queries: list, pivots: dict, k: int) -> DataFrame:
    """Each partition's best ``k`` rows for every query of a block."""
    prepared = {}
    col = pa.array([r["v"] for r in queries], pa.list_(pa.float64()))
    names = np.array([r["id"] for r in queries], np.int64)
    for at, q in _by_length(col):
        n, normal = q.shape[1], _normal(q)
        seeds, points = pivots.get(n, (np.empty(0, np.int64), np.empty((0, n))))
        first = np.where(names[at][normal][:, None] == seeds, -np.inf, q[normal] @ points.T)
        floor = -np.sort(-first, axis=1)[:, k - 1] if len(seeds) >= k else np.full(int(normal.sum()), -np.inf)
        prepared[n] = (names[at], q, normal, _distances(q[normal], points), floor)
    shared = rows.sparkSession.sparkContext.broadcast(prepared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        best = {n: _Best(ids[normal], k, floor.copy()) for n, (ids, _, normal, _, floor) in blocks.items()}
        out = []
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(s, BLOCK_ROWS)
                ids = b.column(0).to_numpy()
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                dist, ends = b.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for at, x in _by_length(b.column(1)):
                    n = x.shape[1]
                    if n not in blocks:
                        continue
                    names_, q, normal, dq, _ = blocks[n]
                    usual = _normal(x)
                    some = at[usual]
                    dx = dist[(ends[some] - dq.shape[1])[:, None] + np.arange(dq.shape[1])]
                    _evaluate(best[n], q[normal], dq, ids[some], x[usual], dx)
                    out += _exactly(names_, q, ids[at[~usual]], x[~usual], k)
                    out += _exactly(names_[~normal], q[~normal], ids[some], x[usual], k)
            if out:
                yield _rows(out)
                out = []
        for b in best.values():
            for i, qid in enumerate(b.ids.tolist()):
                out += [(qid, r, int(s)) for r, s in zip(b.row[i].tolist(), b.score[i].tolist())]
            if len(out) > 1 << 16:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int64()) for c in zip(*out)]
    return pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 1.0,
          pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner products for every query.

    ``is_query`` is a condition on the column ``id`` (the key as a long). Components are ``floor(scale * x)``. Candidates
    are all rows but the query's own (those with its key); fewer than ``k`` of them are all returned. Equal products go
    to the smaller key. Rows whose key or vector is NULL, or with a component that is NULL or not finite once scaled, take no part; vectors
    are compared with those of their own length (the empty ones too, at 0). A repeated row is a candidate each time; of
    queries with the same key the smallest vector counts. A product beyond 64 bits is returned, and ordered, as the
    nearest long. No rows: no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, scale)
    points = _pivots(rows, pivots)
    rows = cut_lineage(pivot_table(rows, points))
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    passes = max(1, -(-n * 8 * max(longest or 1, 1) // QUERY_BYTES))
    found = []
    for p in range(passes):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).collect()
        if not block:
            continue
        best = _search(rows, block, points, k)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(cut_lineage(best) if passes > 1 else best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    while len(found) > 1:  # a balanced tree of unions
        found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2])] + found[len(found) // 2 * 2:]
    return found[0]


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, scale=256.0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5"""
