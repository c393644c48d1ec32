"""Paged URL scans and batch-partitioned sinks.

The original pages through a URL table with LIMIT/OFFSET (no ORDER BY, so a
page's content is undefined) and writes one file per page. Here every URL gets
a deterministic global position in (url, tie-break) order, computed without
funnelling rows through one task, and the batch number is derived from it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens import fixed
from newslens.session import cut_lineage


def global_positions(df: DataFrame, order: Sequence[str], start: int = 0,
                     position_col: str = "position") -> DataFrame:
    """0-based position (plus ``start``) of every row in ``order``, which must be a total order.

    A range-partitioned sort spreads the rows over all tasks; the sorted rows
    are checkpointed so that the per-partition counts and the numbering read
    identical partitions (also after an executor loss). The running offset of
    each partition comes from a window over one row per partition.
    """
    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # One row per partition of the sort: bounded by the partition count.
    j = s.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    pos = F.lit(start) + F.col("_off") + (F.col("_mid") - F.col("_first"))
    return j.withColumn(position_col, pos).drop("_pid", "_mid", "_off", "_first")


def url_batches(urls: DataFrame, url_col: str = "url", *, tie: Sequence[str], start: int = 0,
                end: int | None = None, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Rows at positions ``start <= p < end`` with their batch ``[batch_start, batch_end)``.

    Equivalent to issuing ``LIMIT size OFFSET o`` for o = start, start+size, …
    against a table ordered by url (the last batch may run past ``end``, like
    the original loop). ``tie`` names columns that order rows of equal or NULL URLs (a total order together with the
    URL, which also lets Spark split such rows over tasks); pass ``()`` only for unique URLs.
    """
    pos = global_positions(urls, [url_col, *tie])
    if end is not None:
        # The original loop issues its last page at an offset below ``end`` and
        # reads a full page from there.
        last_page = start + ((end - 1 - start) // size) * size
        pos = pos.where(F.col("position") < F.lit(last_page + size))
    pos = pos.where(F.col("position") >= F.lit(start))
    b = F.lit(start) + F.floor((F.col("position") - F.lit(start)) / F.lit(size)).cast("long") * F.lit(size)
    return pos.withColumn("batch_start", b).withColumn("batch_end", b + F.lit(size))


def write_batches(df: DataFrame, path: str, fmt: str = "parquet", batch_col: str = "batch_start",
                  mode: str = "overwrite") -> None:
    """One folder per batch (``batch_start=<offset>``), written in parallel by all tasks.

    Rows are clustered by batch first so each batch lands in few files.
    """
    writer = df.repartition(batch_col).write.mode(mode).partitionBy(batch_col)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
