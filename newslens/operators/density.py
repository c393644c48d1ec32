"""Topics found by density: no number of topics is given, and what lies in no dense region is the outlier topic -1.

Neighbours come from tables of random projections (`near_neighbours`), or exactly within a radius (`radius_pairs`). Distances
become mutual reachability: at least each end's distance to its ``min_points``-th point. A minimum spanning forest of the
neighbour graph keeps every component at every distance; along a grid of distances the components form a tree, in which a
topic is a component of ``min_size`` points or more that lives longer, weighted by its points, than its parts do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.operators.graph import components, cut_round, iterative, spanning_forest
from newslens.session import cut_lineage

#: Projection tables, the points that a bucket holds on average, and the further bits that fuller buckets are split by.
TABLES, BUCKET, MORE_BITS = 16, 256, 16
#: Pivots of the exact radius search, the points they are picked from, and the points that a task compares at once.
PIVOTS, PIVOT_SAMPLE, CELL = 32, 2048, 2048
#: Points of a part, two of which a task of the exact search holds, and the parts that fewer points are still dealt over.
PART, PARTS = 32_768, 16
#: Distances at which the tree of components is looked at (quantiles of the forest's weights).
LEVELS = 12
OUTLIER = -1


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with a key and a vector whose components are all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine) \
        .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(col: pa.ListArray) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed over differences: equal points are at 0 exactly."""
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):
        out[i:i + 64] = np.sqrt(((x[i:i + 64, None, :] - y[None]) ** 2).sum(-1))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The rows of one group after the other, from rows sorted by the first ``columns`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(columns))))
        a = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > a or held:
                    yield pa.Table.from_batches([*held, b.slice(a, i - a)])
                held, a, last = [], i, k
        if a < b.num_rows:
            held.append(b.slice(a))
    if held:
        yield pa.Table.from_batches(held)


def near_neighbours(points: DataFrame, k: int, tables: int = TABLES, bucket: int = BUCKET, seed: int = 7) -> DataFrame:
    """(id, other, d): up to ``k`` nearest points of every point (id, v) among those that share a bucket with it in some
    table, nearest first by (d, other).

    A table's bucket is the signs of a point's products with as many random directions as leave ``bucket`` points on
    average. Buckets of more than four times as many are split by further signs, and what the signs cannot split (many
    nearly equal points) by a hash, so no task holds a large bucket; that and the signs can miss neighbours, which the
    tests measure.
    """
    n, dim = points.agg(F.count("*"), F.max(F.size("v"))).first()
    bits = max(0, (max(1, n) - 1) // bucket).bit_length()
    planes = np.random.default_rng(seed).normal(size=(tables, bits + MORE_BITS, dim or 1))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            signs = np.einsum("nd,tbd->tnb", x, planes) > 0
            code = signs @ (1 << np.arange(signs.shape[2] - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(x))), pa.array(code.ravel()),
                                              pa.array(np.tile(b.column(0).to_numpy(), tables))], names=["t", "code", "id"])

    rows = cut_lineage(points.mapInArrow(codes, "t int, code long, id long"))
    out, used, most = [], bits, 4 * bucket
    while True:
        rows = rows.withColumn("c", F.shiftright("code", bits + MORE_BITS - used))
        sizes = rows.groupBy("t", "c").agg(F.count("*").alias("size"))
        rows = cut_round(rows.join(sizes, ["t", "c"]))
        done = (F.col("size") <= most) | F.lit(used == bits + MORE_BITS)
        salt = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("size") / most))
        out.append(rows.where(done & (F.col("size") > 1)).select("t", F.lit(used).alias("u"), "c", salt.alias("s"), "id"))
        rows = rows.where(~done).select("t", "code", "id")
        if used == bits + MORE_BITS or rows.isEmpty():
            break
        used = min(used + 4, bits + MORE_BITS)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 4):
            ids, x = g.column("id").to_numpy(), _matrix(g.column("v").combine_chunks())
            if len(ids) < 2:
                continue
            d = _distances(x, x)
            np.fill_diagonal(d, np.inf)
            m = min(k, len(ids) - 1)
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :m]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(ids[order].ravel()),
                                              pa.array(np.take_along_axis(d, order, 1).ravel())], names=["id", "other", "d"])

    buckets = reduce(DataFrame.unionByName, out).join(points, "id").select("t", "u", "c", "s", "id", "v")
    found = buckets.repartition("t", "u", "c", "s").sortWithinPartitions("t", "u", "c", "s") \
        .mapInArrow(nearest, "id long, other long, d double").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


class _Part:
    """The points of one part in a task: in blocks of ``CELL``, with each block's least and greatest distance to every pivot."""

    def __init__(self, rows: pa.Table, centres: np.ndarray):
        x = _matrix(rows.column("v").combine_chunks())
        d = _distances(x, centres)
        order = np.lexsort((d.min(1), d.argmin(1)))
        self.ids, self.x, self.rows = rows.column("id").to_numpy()[order], x[order], rows.take(pa.array(order))
        self.blocks = [slice(i, min(i + CELL, len(x))) for i in range(0, len(x), CELL)]
        self.low = np.array([d[order[b]].min(0) for b in self.blocks])
        self.high = np.array([d[order[b]].max(0) for b in self.blocks])
        norms = (self.x ** 2).sum(1)
        self.most = float(norms.max())
        one = np.ones(len(x))
        # a product of these rows, left by right, is a squared distance
        self.left = np.column_stack([self.x, norms, one])
        self.right = np.column_stack([-2 * self.x, one, norms])

    def single(self, name: str) -> np.ndarray:
        with np.errstate(over="ignore"):
            return getattr(self, name).astype(np.float32)


def _apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, radius: float) -> bool:
    """Whether no two points with these bounds of their distances to the pivots can be within the radius."""
    gap = np.maximum(low - high2, low2 - high)
    return bool((gap > radius * (1 + 1e-9) + 1e-9 * np.maximum(high, high2)).any())


def _near_blocks(a: _Part, b: _Part | None, radius: float, wanted=lambda i, j: True) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(block of a, block of b, which points are within the radius and of different ids) for the blocks that may hold such
    points, each pair of blocks once; of ``a`` with itself if ``b`` is None.

    Squared distances come from a matrix product, in single precision where that is exact enough; what lies within its error
    of the radius is computed again from differences, so the answer is that of the differences.
    """
    other = a if b is None else b
    dim, limit = a.x.shape[1], radius * radius
    error = 2 * (dim + 4) * (a.most + other.most)
    single = error * np.finfo(np.float32).eps < limit / 16
    error *= np.finfo(np.float32 if single else np.float64).eps
    left, right = (a.single("left"), other.single("right")) if single else (a.left, other.right)
    for m, i in enumerate(a.blocks):
        for n, j in enumerate(other.blocks):
            if (b is None and n < m) or not wanted(i, j) or _apart(a.low[m], a.high[m], other.low[n], other.high[n], radius):
                continue
            with np.errstate(all="ignore"):
                d = left[i] @ right[j].T
                near = ~(d > limit + error)
                unsure = near & ~(d <= limit - error)
            if unsure.any():
                u, v = np.nonzero(unsure)
                for s in range(0, len(u), 1 << 16):
                    p, q = u[s:s + (1 << 16)], v[s:s + (1 << 16)]
                    near[p, q] = np.sqrt(((a.x[i][p] - other.x[j][q]) ** 2).sum(-1)) <= radius
            x, y = a.ids[i], other.ids[j]
            if np.isin(x, y).any():
                near &= x[:, None] != y
            yield i, j, near


def _placed(points: DataFrame, radius: float, pivots: int) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]] | None:
    """((part, id, v) of the points, the pivots, the pairs of parts that may hold points within the radius); None without points.

    A point belongs to the cell of its nearest pivot. Small cells beside each other share a part, and large ones are dealt
    over several by a hash of the id, so that a part holds about ``PART`` points at most, whatever the points are like. Two
    parts are left out if, for some pivot, their points' distances to it differ by more than the radius. The driver holds
    the pivots and, for every part, its bounds.
    """
    sample = points.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()  # a top-k, never more than the bound
    if not sample:
        return None
    x = np.array([r["v"] for r in sample])
    centres = x[np.unique(np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int))]
    mean = centres - centres.mean(0)
    centres = centres[np.argsort(mean @ np.linalg.svd(mean, full_matrices=False)[2][0], kind="stable")]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = _distances(_matrix(b.column(1)), centres).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], names=["cell", "id", "v"])

    rows = cut_lineage(points.mapInArrow(cells, "cell int, id long, v array<double>"))
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    most = min(PART, max(CELL, -(-sum(sizes.values()) // PARTS)))
    first, groups, part, held = [], [], 0, 0
    for c in range(len(centres)):
        n = sizes.get(c, 0)
        if held and held + n > most:
            part, held = part + 1, 0
        first.append(part)
        groups.append(max(1, -(-n // most)))
        part, held = (part + groups[-1], 0) if n > most else (part, held + n)
    at = F.col("cell") + 1
    start, among = (F.element_at(F.array(*map(F.lit, z)), at) for z in (first, groups))
    placed = rows.select((start + F.pmod(F.xxhash64("id", F.lit(3)), among)).cast("int").alias("part"), "id", "v")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            parts, d = b.column(0).to_numpy(), _distances(_matrix(b.column(1)), centres) if b.num_rows else None
            for q in np.unique(parts):
                here = d[parts == q]
                low[q] = np.minimum(low.get(q, np.inf), here.min(0))
                high[q] = np.maximum(high.get(q, 0), here.max(0))
        k = len(centres)
        for q in low:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, q, np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                                              pa.array(low[q]), pa.array(high[q])], names=["part", "pivot", "low", "high"])

    found = placed.select("part", "v").mapInArrow(bounds, "part int, pivot int, low double, high double").groupBy("part", "pivot") \
        .agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = {}, {}
    for r in found:
        low.setdefault(r["part"], np.zeros(len(centres)))[r["pivot"]] = r["low"]
        high.setdefault(r["part"], np.zeros(len(centres)))[r["pivot"]] = r["high"]
    tiles = [(p, q) for p in sorted(low) for q in sorted(low) if p <= q and (p == q or not _apart(low[p], high[p], low[q], high[q], radius))]
    return placed, centres, tiles


def _meet(placed: DataFrame, centres: np.ndarray, tiles: list[tuple[int, int]], fn, schema: str) -> DataFrame:
    """``fn(a, b)`` for every pair of parts, in a task that holds the two; ``b`` is None for a part with itself. Columns
    after (part, id, v) go along."""
    if not tiles:
        return placed.sparkSession.createDataFrame([], schema)
    deal = [(p, t, 2 if p == q else 0) for t, (p, q) in enumerate(tiles)] + [(q, t, 1) for t, (p, q) in enumerate(tiles) if p != q]
    deal = placed.sparkSession.createDataFrame(deal, "part int, tile int, side int")
    rows = placed.join(F.broadcast(deal), "part").select("tile", "side", *placed.columns[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for g in _grouped(batches, 2):
            tile, side = g.column("tile")[0].as_py(), g.column("side")[0].as_py()
            part = _Part(g, centres) if side != 1 or (held and held[0] == tile) else None
            if side == 2:
                yield from fn(part, None)
            elif side == 1 and part:
                yield from fn(held[1], part)
            held = (tile, part) if side == 0 else None

    return rows.repartition(len(tiles), "tile").sortWithinPartitions("tile", "side").mapInArrow(run, schema)


def radius_pairs(points: DataFrame, radius: float, pivots: int = PIVOTS) -> DataFrame:
    """(id, other, d): every ordered pair of points (id, v) at most ``radius`` apart, exactly. See `_placed` and `_meet`: a
    task compares two parts of bounded size, and only pairs within the radius leave it; they may be as many as all."""
    schema = "id long, other long, d double"
    at = _placed(points, radius, pivots)
    if at is None:
        return points.sparkSession.createDataFrame([], schema)

    def pairs(a: _Part, b: _Part | None) -> Iterator[pa.RecordBatch]:
        other = a if b is None else b
        for i, j, near in _near_blocks(a, b, radius):
            u, v = np.nonzero(near)
            for s in range(0, len(u), 1 << 16):
                p, q = i.start + u[s:s + (1 << 16)], j.start + v[s:s + (1 << 16)]
                d = np.sqrt(((a.x[p] - other.x[q]) ** 2).sum(-1))
                x, y = a.ids[p], other.ids[q]
                both = [(x, y)] if b is None and i == j else [(x, y), (y, x)]
                for x, y in both:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(d)], names=["id", "other", "d"])

    return _meet(*at, pairs, schema)


class _Union:
    """Components of numbered nodes: ``root`` of every node, kept by `join`."""

    def __init__(self, root: np.ndarray):
        self.root = root

    def join(self, u: np.ndarray, v: np.ndarray) -> list[int]:
        """Joins u[i] to v[i] one after the other; the positions that joined two components."""
        up, used = {}, []

        def find(r):
            while (n := up.get(r, r)) != r:
                up[r] = up.get(n, n)
                r = n
            return r

        for at, (x, y) in enumerate(zip(self.root[u].tolist(), self.root[v].tolist())):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(at)
        to = np.arange(self.root.max() + 1)
        for r in list(up):
            to[r] = find(r)
        self.root = to[self.root]
        return used


def _links(a: _Part, b: _Part | None, radius: float, union: _Union, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of ``a`` and of ``b`` (numbered from ``shift``) that join components. Blocks of one component are passed over."""
    def apart(i, j):
        x, y = union.root[i], union.root[shift + j.start:shift + j.stop]
        return min(x.min(), y.min()) != max(x.max(), y.max())

    for i, j, near in _near_blocks(a, b, radius, apart):
        while True:
            near &= union.root[i][:, None] != union.root[shift + j.start:shift + j.stop]
            u = np.flatnonzero(near.any(1))
            if not len(u):
                break
            v = near[u].argmax(1)
            u, v = i.start + u, shift + j.start + v
            used = union.join(u, v)
            yield u[used], v[used]


def near_counts(placed: DataFrame, centres: np.ndarray, tiles: list[tuple[int, int]], radius: float) -> DataFrame:
    """(id, n_near): the points within the radius of every point that has any, counted within tasks: no pair leaves them."""
    def counts(a: _Part, b: _Part | None) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(a.ids), np.int64)
        m = n if b is None else np.zeros(len(b.ids), np.int64)
        for i, j, near in _near_blocks(a, b, radius):
            n[i] += near.sum(1)
            if b is not None or i != j:
                m[j] += near.sum(0)
        for part, z in [(a, n)] if b is None else [(a, n), (b, m)]:
            yield pa.RecordBatch.from_arrays([pa.array(part.ids[z > 0]), pa.array(z[z > 0])], names=["id", "n"])

    return _meet(placed, centres, tiles, counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_near"))


def near_components(placed: DataFrame, centres: np.ndarray, tiles: list[tuple[int, int]], radius: float) -> DataFrame:
    """(id, root): the smallest id that is reachable from a point over steps within the radius.

    First every part's own components are found in a task; then two parts are compared only where their points' components
    are not one yet, and a task returns no more than a forest over the components of its two parts.
    """
    def inside(a: _Part, b: None) -> Iterator[pa.RecordBatch]:
        names, at = np.unique(a.ids, return_inverse=True)  # rows that share an id are one node
        union = _Union(at)
        for _ in _links(a, None, radius, union, 0):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(names[union.root])], names=["id", "comp"])

    def across(a: _Part, b: _Part) -> Iterator[pa.RecordBatch]:
        own = [part.rows.column("comp").to_numpy() for part in (a, b)]
        both = np.concatenate(own)
        for u, v in _links(a, b, radius, _Union(np.unique(both, return_inverse=True)[1]), len(a.ids)):
            yield pa.RecordBatch.from_arrays([pa.array(both[u]), pa.array(both[v])], names=["a", "b"])

    comps = cut_round(_meet(placed, centres, [(p, q) for p, q in tiles if p == q], inside, "id long, comp long").distinct())
    least = cut_round(comps.groupBy("id").agg(F.min("comp").alias("comp")))  # one each, unless an id comes with several vectors
    same = comps.join(least.withColumnRenamed("comp", "first"), "id").where("comp <> first").select(F.col("first").alias("a"), F.col("comp").alias("b"))
    named = placed.join(least, "id").select("part", "id", "v", "comp")
    steps = _meet(named, centres, [(p, q) for p, q in tiles if p != q], across, "a long, b long").unionByName(same)
    roots = components(steps)
    return least.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("root", "comp").alias("root"))


@iterative
def core_clusters(df: DataFrame, radius: float, min_points: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_near, cluster) for every row with a key and a finite vector: how many other rows lie within ``radius``, and
    for core rows (``min_points`` with itself) the smallest key of the core rows that are connected over such steps; -1
    for all others. Keys are taken to be unique, and vectors to be of one length.

    Rows are compared in pairs of parts of bounded size, which tasks only count and join to components: what leaves the
    tasks grows with the rows and the parts, not with the pairs. In dense data the comparisons themselves are quadratic."""
    at = _placed(_points(df, key, vector), radius, PIVOTS)
    if at is None:
        return df.sparkSession.createDataFrame([], f"`{key}` long, n_near long, cluster long")
    placed, centres, tiles = at
    counts = near_counts(placed, centres, tiles, radius)
    near = placed.select("id").join(counts, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    near = cut_round(near.withColumn("core", F.col("n_near") + 1 >= min_points))
    core = placed.join(near.where("core").select("id").distinct(), "id", "left_semi").select("part", "id", "v")
    roots = near_components(core, centres, tiles, radius)
    return near.join(roots, "id", "left").select(
        F.col("id").alias(key), "n_near", F.when(F.col("core"), F.col("root")).otherwise(OUTLIER).cast("long").alias("cluster"))


def mutual_reachability(neighbours: DataFrame, min_points: int) -> DataFrame:
    """(a, b, w): an edge for every neighbour pair; ``w`` is the greatest of the distance and both ends' core distances
    (to the ``min_points``-th point, itself the first). A point with fewer neighbours has no edge."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    core = neighbours.withColumn("place", place).where(F.col("place") == max(1, min_points - 1)).select("id", F.col("d").alias("core"))
    ends = neighbours.join(core, "id").join(core.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    return ends.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")) \
        .agg(F.min(F.greatest("d", "core", "core2")).alias("w"))


@iterative
def stable_clusters(forest: DataFrame, min_size: int, levels: int = LEVELS) -> DataFrame:
    """(node, cluster, level): the nodes of the most stable clusters of a weighted forest (a, b, w).

    At each distance of the grid the components of the edges up to it are taken, those of ``min_size`` nodes or more count.
    Going up the grid a component either continues the only one inside it or, with none or several inside, is new. Its
    stability is the sum over its distances of its size times the step in 1 / distance to the next one; the last distance
    adds nothing. A component is a cluster if its stability is at least the sum of the best ones inside it and no
    component around it is one. ``cluster`` is the smallest node of the cluster at the distance where it is largest, and
    ``level`` the position of that distance.
    """
    spark = forest.sparkSession
    grid = forest.where("w > 0").select(F.percentile_approx("w", [(i + 1) / levels for i in range(levels)], 10_000)).first()[0] or []
    cuts = sorted({0.0, *grid} if forest.where("w = 0").limit(1).count() else set(grid))
    none = spark.createDataFrame([], "node long, cluster long, level int")
    if not cuts:
        return none
    # all distances at once: the node of a distance is the node's position in a product with the grid
    n = len(cuts)
    at = F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("level")
    edges = forest.select("a", "b", "w", at).where(F.col("w") <= F.element_at(F.array(*map(F.lit, cuts)), F.col("level") + 1))
    # ids become dense enough by pairing: a struct (level, node) orders by level, then node
    part = components(edges.select(F.struct("level", F.col("a").alias("n")).alias("a"), F.struct("level", F.col("b").alias("n")).alias("b")))
    member = cut_round(part.select(F.col("node.level").alias("level"), F.col("node.n").alias("node"), F.col("root.n").alias("comp")))
    sizes = cut_round(member.groupBy("level", "comp").agg(F.count("*").alias("size")).where(F.col("size") >= min_size))
    inverse = [1 / c if c else 2 / cuts[1] if n > 1 else 0.0 for c in cuts]
    state, chains = None, []
    for i in range(n):
        here = sizes.where(F.col("level") == i).select("comp", "size")
        gain = F.col("size") * F.lit(inverse[i] - inverse[i + 1] if i + 1 < n else 0.0)
        if state is None:
            now = here.select("comp", "size", F.struct(F.lit(i).alias("level"), F.col("comp").alias("of")).alias("chain"),
                              gain.alias("own"), F.lit(0.0).alias("inner"))
        else:
            up = member.where(F.col("level") == i).select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            inside = state.join(up, "comp").groupBy("above").agg(
                F.count("*").alias("parts"), F.min("chain").alias("chain"), F.min("own").alias("own"), F.min("inner").alias("inner"),
                F.sum(F.greatest("own", "inner")).alias("best")).withColumnRenamed("above", "comp")
            one = F.col("parts") == 1
            now = here.join(inside, "comp", "left").select(
                "comp", "size", F.when(one, F.col("chain")).otherwise(F.struct(F.lit(i).alias("level"), F.col("comp").alias("of"))).alias("chain"),
                (F.when(one, F.col("own")).otherwise(0.0) + gain).alias("own"),
                F.when(one, F.col("inner")).otherwise(F.coalesce("best", F.lit(0.0))).alias("inner"))
        state = cut_round(now)
        chains.append(state.select(F.lit(i).alias("level"), "comp", "chain", "own", "inner"))
    every = reduce(DataFrame.unionByName, chains)
    last = every.groupBy("chain").agg(F.max(F.struct("level", "own", "inner", "comp")).alias("z"))
    good = last.where(F.col("z.own") >= F.col("z.inner")).select("chain", F.col("z.level").alias("top"), F.col("z.comp").alias("cluster"))
    named = every.join(good, "chain").select("level", "comp", "top", "cluster")
    return member.join(named, ["level", "comp"]).groupBy("node") \
        .agg(F.max(F.struct("top", "cluster")).alias("m")).select("node", F.col("m.cluster").alias("cluster"), F.col("m.top").alias("level"))


@iterative
def density_topics(df: DataFrame, key: str = "vec_id", vector: str = "embedding", min_size: int = 10, min_points: int = 5,
                   neighbours: int = 15, levels: int = LEVELS) -> DataFrame:
    """(key, topic) for every row with a key: the smallest key of the row's dense cluster, or -1 for outliers and rows
    without a finite vector. Keys are taken to be unique, and vectors to be of one length. No rows: no rows."""
    points = cut_lineage(_points(df, key, vector))
    near = cut_round(near_neighbours(points, max(neighbours, min_points)))
    forest = cut_round(spanning_forest(cut_round(mutual_reachability(near, min_points))))
    found = stable_clusters(forest, min_size, levels)
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"))
    return keys.join(found, "node", "left").select(F.col("node").alias(key), F.coalesce("cluster", F.lit(OUTLIER)).cast("long").alias("topic"))
