"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by covering LSH.

Covering masks: every bit position gets a non-zero vector of radius+1 bits, and every non-zero
vector ``v`` of that length gives one mask that keeps the positions whose vector has an odd inner
product with ``v``. The vectors of at most ``radius`` differing positions cannot span the whole
space, so some ``v`` is orthogonal to all of them: two fingerprints within the radius agree on
all kept bits of that mask, that is they meet in that table with certainty.

A bucket holds distinct fingerprints only (copies are one row). Buckets above ``BUCKET`` are found
by counting, and are split again by the same construction on the bits that their mask leaves
free. About half of the free bits go at each level, so the recursion ends within a few levels, no
task holds more than ``BUCKET`` fingerprints, and no pair within the radius is lost. Each
bucket emits the edges of a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import cut_lineage, map_batches, names_free
from newslens.llm.components import connected
from newslens.sources.tables import table

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Most distinct fingerprints that are compared with each other in one task.
BUCKET = 256
#: Shingles hashed at once (bounds the memory for a very long text).
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of ``text`` as an unsigned 64-bit number: A-Z lower-cased, words split at ASCII white space, shingles
    of ``shingle`` words joined by a space, repeats included (fewer words: the whole sequence; none: 0). A bit is 1
    if it is set in over half of the shingles' XXH64 hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[a:min(a + BLOCK, n)].tolist(),
                                                                   stops[a:a + BLOCK].tolist())), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, h): the fingerprint of every row's whole text as a signed long, and Spark's hash of the text. NULL text
    counts as empty."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType()),
                           T.StructField("h", T.LongType())])

    def run(b: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
        return {key: b.column(0), "fp": fp.view(np.int64), "h": b.column(2)}

    plain = F.coalesce(F.col(text), F.lit(""))
    return map_batches(docs.select(F.col(key), plain.alias("t"), F.xxhash64(plain).alias("h")), run, schema)


def covering_masks(positions: Sequence[int], radius: int) -> list[int]:
    """Masks over the given bit positions: any two values that differ in at most ``radius`` of them agree on all
    bits of at least one mask."""
    span = (1 << (radius + 1)) - 1
    vectors = sorted(range(1, span + 1), key=int.bit_count)  # unit vectors first: then every mask keeps a bit
    vector = {p: vectors[i % span] for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, span + 1)]


def finer_masks(masks: Iterable[int], radius: int, bucket: int = BUCKET) -> dict[int, list[int]]:
    """For every mask that leaves more than ``bucket`` values possible: itself together with each covering mask
    over its free bits."""
    out = {}
    if bucket < 1 << radius:
        raise ValueError(f"buckets of {bucket} are too small for radius {radius}")
    for m in set(masks):
        free = [p for p in range(64) if not m >> p & 1]
        if 1 << len(free) > bucket:
            out[m] = [m | f for f in covering_masks(free, radius)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(fps: DataFrame, masks: Column) -> DataFrame:
    """A row (m, k, fp) for every mask of the array column: the masked fingerprint is the bucket's key."""
    return fps.select("fp", F.explode(masks).alias("m")) \
        .select("m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Positions of the edges of a spanning forest of the links among a bucket's fingerprints."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    seen, a, b = np.zeros(len(fps), bool), [], []
    for root in range(len(fps)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            x = front.pop()
            new = np.flatnonzero(near[x] & ~seen).tolist()
            seen[new] = True
            a, b, front = a + [x] * len(new), b + new, front + new
    return a, b


def _run_links(m: np.ndarray, k: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of sorted rows. A bucket whose neighbours in order all link is a chain; only the
    others are compared in full."""
    same = (m[1:] == m[:-1]) & (k[1:] == k[:-1])
    near = same & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= radius)
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    sizes = np.diff(np.append(starts, len(fp)))
    broken = np.add.reduceat(np.append(same & ~near, False).astype(np.int64), starts) > 0
    whole = np.repeat(~broken | (sizes < 3), sizes)
    at = np.flatnonzero(near & whole[:-1])
    a, b = [fp[at]], [fp[at + 1]]
    for s, n in zip(starts[broken & (sizes > 2)].tolist(), sizes[broken & (sizes > 2)].tolist()):
        x, y = _forest(fp[s:s + n], radius)
        a.append(fp[s:s + n][x])
        b.append(fp[s:s + n][y])
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of buckets (m, k, fp) that are each small enough for one task to hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def linked(cols):
            a, b = _run_links(cols[0], cols[1], cols[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield linked([c[:cut] for c in cols])
        if len(held[0]):
            yield linked(held)

    return rows.select("m", "k", "fp").repartition("m", "k").sortWithinPartitions("m", "k", "fp") \
        .mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` that connect exactly what the pairs within ``radius``
    differing bits connect."""
    masks, out = covering_masks(range(64), radius), []
    rows = _bucketed(fps, F.array(*[F.lit(_signed(m)) for m in masks]))
    while True:
        counts = rows.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
        shared = cut_lineage(rows.join(counts, ["m", "k"]))
        out.append(_bucket_links(shared.where(F.col("n") <= bucket), radius))
        large = shared.where(F.col("n") > bucket).select("m", "fp")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out).distinct()
        finer = finer_masks(masks, radius, bucket)
        table_ = F.create_map(*[x for m, fs in finer.items() for x in
                                (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in fs]))])
        rows = _bucketed(large.select("fp", F.element_at(table_, F.col("m")).alias("ms")), F.col("ms")).distinct()
        masks = [f for fs in finer.values() for f in fs]


def _rooted(docs: DataFrame, key: str, text: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp, hash of the text) of every row, and (fp, first, root) of every fingerprint: the first row that has it,
    as a struct of (no key, key, hash of the text), and the fingerprint that stands for its component. Copies shrink to
    one row a task before anything is shuffled."""
    marked = cut_lineage(fingerprints(docs, key, text, shingle))
    row = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), "h")
    fps = cut_lineage(marked.groupBy("fp").agg(F.min(row).alias("first")))
    roots = connected(links(fps, radius))
    return marked, fps.join(roots, fps["fp"] == roots["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest key that is
    reachable over links. Rows with the same text have the same fingerprint, so copies need no links. A NULL or
    white-space text has fingerprint 0 and is linked like any other. Repeated rows stay. Rows without a key take
    part; they are NULL themselves, and a component of such rows alone has a NULL id. No rows: no rows. Further
    columns of ``docs`` are not read.
    """
    marked, rooted = _rooted(docs, key, text, shingle, radius)
    ids = rooted.groupBy("root").agg(F.min("first.k").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for every component of near-duplicates, with all its columns: that with the smallest key, a
    row without a key only if there is no other; among rows with that key, the text with the smallest hash."""
    _, rooted = _rooted(docs, key, text, shingle, radius)
    best = rooted.groupBy("root").agg(F.min("first").alias("b"))
    k, h, n = names_free(docs, "_k", "_h", "_n")
    best = best.select(F.col("b.k").alias(k), F.col("b.h").alias(h)).distinct()
    rows = docs.withColumn(n, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = rows.join(best, rows[key].eqNullSafe(best[k]) & (rows[n] == best[h]), "left_semi")
    first = Window.partitionBy(key, n).orderBy(F.lit(0))  # rows equal in key and text are one document
    return kept.withColumn(h, F.row_number().over(first)).where(F.col(h) == 1).drop(h, n)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
