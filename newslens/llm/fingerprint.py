"""Document fingerprints from prefix polynomial hashes, and their likeness to an edited text's and a neighbour's.

A fingerprint is the text's length, the 62-bit hash of the whole text, and at each fitting scale the smallest
hashes of its spans. Equal texts have equal fingerprints; the share of common smallest hashes estimates how
much of two texts is common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import bound_batches, char_chunks, thin
from newslens.llm.prefixhash import PrefixHashes
from newslens.sources.tables import table

#: (span width, shortest text, longest text): neighbouring scales overlap, so that texts whose lengths differ by less than
#: a half always have one in common. Other pairs are compared at the widest scale of the shorter text.
SCALES = ((2, 0, 32), (5, 16, 256), (16, 128, None))
#: Smallest span hashes that are kept at a scale.
KEEP = 64
#: Keys that are sampled to find the borders of the key ranges, per range.
SAMPLE = 20


def _smallest(h: np.ndarray) -> np.ndarray:
    """The KEEP smallest distinct hashes of the spans, ascending. The second and later occurrences of a span have
    hashes of their own, so that a text that repeats itself is compared by how often it does."""
    s = np.sort(h.astype(np.uint32))
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if not new.all():
        place = np.arange(len(s), dtype=np.uint32)
        times = place - np.maximum.accumulate(np.where(new, place, 0))
        mixed = (s ^ (times * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77)
        s = np.where(times > 0, (mixed ^ (mixed >> np.uint32(13))) & np.uint32((1 << 31) - 1), s)
    if len(s) > 8 * KEEP:
        s = np.partition(s, 4 * KEEP)[:4 * KEEP]  # few of them are equal: KEEP distinct ones remain
    return np.unique(s)[:KEEP]


class Sketches(dict):
    """Span width -> smallest hashes, at the scales that fit a text; at narrower ones they are made when asked for."""

    def __init__(self, windows: dict[int, np.ndarray], start: int, size: int):
        super().__init__()
        self._windows, self._start, self._size = windows, start, size
        for w, lo, hi in SCALES:
            if size >= max(w, lo) and (hi is None or size <= hi):
                self[w] = self[w]

    def __missing__(self, w: int) -> np.ndarray:
        return _smallest(self._windows[w][self._start:self._start + self._size - w + 1])


class Fingerprints:
    """Fingerprints of several texts, with the prefix hashes they are made of."""

    def __init__(self, texts: list[str]):
        self.hashes = PrefixHashes(texts)
        whole, starts, sizes = self.hashes.whole().tolist(), self.hashes.start.tolist(), self.hashes.size.tolist()
        windows = {w: self.hashes.windows(w) for w, *_ in SCALES}
        self.sketches = [Sketches(windows, a, n) for a, n in zip(starts, sizes)]
        self.text = [f"{n:x}-{h:016x}" + "".join(f"-{w:x}:{s.astype('>u4').tobytes().hex()}" for w, s in k.items())
                     for n, h, k in zip(sizes, whole, self.sketches)]


def likeness(a: str, b: str, x: Sketches, y: Sketches) -> float:
    """0 to 1 for two fingerprints with their sketches: 1 if they are equal; else, at the widest common scale (without
    one, the widest of the shorter text), the share of both texts' spans that is common (twice the common ones over the
    sum), estimated from the KEEP smallest hashes of the two together; 0 if a text is too short for any span."""
    if a == b:
        return 1.0
    if not x or not y:
        return 0.0
    w = max(x.keys() & y.keys(), default=min(max(x), max(y)))
    p, q = set(x[w].tolist()), set(y[w].tolist())
    union = sorted(p | q)[:KEEP]
    j = sum(h in p and h in q for h in union) / len(union)
    return 2 * j / (1 + j)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the first as many characters of ``after``."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def _range_of(key: Column, borders: list) -> Column:
    """How many of the ascending borders are at most ``key``, by a search in two steps."""
    if not borders:
        return F.lit(0)
    k = math.isqrt(len(borders)) + 1
    groups = [borders[a:a + k] for a in range(0, len(borders), k)]
    first = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(first, lambda b: b <= key))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(group, F.lit(1)))
    return F.coalesce(F.when(group > 0, (group - 1) * k + F.size(F.filter(inner, lambda b: b <= key))), F.lit(0))


def with_neighbours(docs: DataFrame, key: str, text: str, ranges: int | None = None) -> DataFrame:
    """(range, ahead, key, text), dealt and sorted so that every row but the last of a range is followed by the next
    document; a range ends with the first row of the next one (``ahead``), the last range with that of the first.

    The borders come from a bounded sample of the keys, the first key of every range from an aggregate with one row
    per range; a text is sent twice only if its key is the first of a range. Rows with equal keys follow each other in
    the order of their texts' hashes, all in one range, NULL keys first.
    """
    spark = docs.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(key).where(F.col(key).isNotNull())
    sample = sorted(r[0] for r in thin(keys, key, SAMPLE * n).distinct().collect())  # about SAMPLE * n keys
    borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")) \
        .withColumn("r", _range_of(F.col("k"), borders))
    firsts = sorted((r.r, r.k) for r in rows.groupBy("r").agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("u"))
                    .select("r", F.when(~F.col("u"), F.col("k")).alias("k")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    schema = T.StructType([T.StructField("first", docs.schema[key].dataType), T.StructField("to", T.IntegerType())])
    heads = F.broadcast(spark.createDataFrame(before, schema))  # a row per range
    return rows.join(heads, rows["k"].eqNullSafe(heads["first"]), "left") \
        .select("k", "t", F.xxhash64("t").alias("h"), F.explode(F.when(
            F.col("to").isNull(), F.array(F.struct(F.col("r"), F.lit(False).alias("ahead")))).otherwise(F.array(
                F.struct(F.col("r"), F.lit(False).alias("ahead")), F.struct(F.col("to").alias("r"), F.lit(True).alias("ahead"))))
        ).alias("x")).select("x.r", "x.ahead", "k", "h", "t").repartition("r").sortWithinPartitions("r", "ahead", "k", "h")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """A row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and, by binary search on the prefix hashes, the characters that the text shares with the edited and the next text
    from their starts (lce_edited, lce_next).

    The next document is the one with the next key; after the last comes the first. NULL text counts as empty. A
    single document is its own next. Repeated rows stay and follow each other; rows without a key come first. No
    rows: no rows. Further columns are not read.
    """
    import hashlib

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType())] \
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")] \
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")] \
        + [T.StructField(c, T.LongType()) for c in ("lce_edited", "lce_next")]
    schema = T.StructType(fields)

    def finished(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows for all texts but the last, which is only the next one of its forerunner."""
        from pyspark.sql.pandas.types import to_arrow_schema

        own, plain = to_arrow_schema(schema), texts[:-1]
        for a, b in char_chunks(plain):
            here, after = plain[a:b], texts[a + 1:b + 1]
            changed = [edited(t, u) for t, u in zip(here, after)]
            x, y, z = Fingerprints(here), Fingerprints(changed), Fingerprints(after[-1:])
            nxt, sketches = x.text[1:] + z.text, x.sketches[1:] + z.sketches
            cols = [keys[a:b], [len(t) for t in here], [hashlib.sha256(t.encode()).hexdigest() for t in changed], x.text, y.text,
                    [likeness(*v) for v in zip(x.text, y.text, x.sketches, y.sketches)],
                    [likeness(*v) for v in zip(x.text, nxt, x.sketches, sketches)],
                    x.hashes.extension(y.hashes), x.hashes.extension(PrefixHashes(after))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, own)], schema=own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, texts, closed = None, [], [], False
        for batch in batches:
            for r, ahead, k, t in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if r != at:
                    at, keys, texts, closed = r, [], [], False
                if closed:
                    continue  # a further row with the key that the next range starts with
                keys.append(k)
                texts.append(t)
                closed = ahead
                if ahead or len(texts) > 256:
                    yield from finished(keys, texts)
                    keys, texts = keys[-1:], texts[-1:]

    return bound_batches(with_neighbours(docs, key, text, ranges)).mapInArrow(run, schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
