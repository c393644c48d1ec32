"""Helpers shared by the corpus operators: Arrow-batch maps, code-point arrays, table columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.session import cut_lineage  # noqa: F401  (re-exported: checkpoint in the shared folder)

#: Rows per Arrow batch. Texts may be long, so a batch is kept to this many of them.
BATCH_ROWS = 512
#: Characters that are turned into numpy arrays at once inside a task (a longer text goes alone).
CHUNK_CHARS = 1 << 19


def bound_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Lower the session's Arrow batch length to ``rows`` (rows hold whole texts); returns ``df``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))
    return df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None],
                schema: T.StructType | str) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``; a dict result is built into a batch of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b) if b.num_rows else None
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            if out is not None and out.num_rows:
                yield out

    return bound_batches(df).mapInArrow(run, schema)


def char_chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` of about ``limit`` characters each; a longer text is a range of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def code_points(text: str) -> np.ndarray:
    """The code points of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def crc_mod(c: str | Column, m: int) -> Column:
    """crc32 of the value's decimal text, modulo ``m`` (NULL for NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(c.cast("string").cast("binary")) % m


def thin(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows of the narrow table ``df`` (all, if it has no more), picked by a hash of ``key``: a sample that
    does not depend on row order or partitioning. Rows that share a key stay or go together."""
    m = df.count() // max(1, n)
    return df.where(F.pmod(F.xxhash64(key), F.lit(m)) == 0) if m > 1 else df


def take_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hashes of ``key`` in a thinned table of several times as
    many: what tasks hand on for the pick grows with ``n``, not with the table."""
    return thin(df, key, 16 * n).orderBy(F.xxhash64(key, F.lit(1)), key).limit(n)


def names_free(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until none clashes with a column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def distinct_names(*names: str) -> list[str]:
    """``names``, each with underscores added until it differs from those before it."""
    out: list[str] = []
    for n in names:
        while n.lower() in (o.lower() for o in out):
            n += "_"
        out.append(n)
    return out
