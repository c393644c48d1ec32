"""Incremental headline ingest as a Structured Streaming job.

Landed API responses (JSON lines) are flattened, and each micro-batch appends the first row of every
URL that the article store does not hold yet. There is no watermark: an article is new if its URL is, whatever date
it bears, so late, undated and misdated headlines are kept. The anti join makes a replayed batch
idempotent. Lines that are not a readable response go to a reject folder, one partition per batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newslens.functions import dates
from newslens.operators.dedupe import MAX_BATCH_KEYS, keep_first, only_new
from newslens.sources.headlines import parse_responses, rejected_lines
from newslens.sources.tables import read_stored

#: Which of a URL's rows in one batch is first: a total order, so that a replay picks the same row.
FIRST = ("publishedAt", "title", "source", "description", "language")


def headline_rows(lines: DataFrame) -> DataFrame:
    """Landed lines (``value``) → article rows; an unreadable date is a NULL ``datetime``."""
    return parse_responses(lines, "value").withColumn("datetime", dates.format_datetime("publishedAt"))


def append_new(store: str, rejects: str, key: str = "url"):
    """foreachBatch function: append the first row of every key that the store does not hold yet."""

    def write(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        # The micro-batch is read more than once (rejects, size check, the write): keep it.
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rejected_lines(lines, "value").write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
            rows = headline_rows(lines)
            batch = keep_first(rows, key, [c for c in FIRST if c in rows.columns]).persist(StorageLevel.MEMORY_AND_DISK)
            stored = read_stored(spark, store)
            fresh = batch if stored is None else only_new(stored.select(key), batch, key, max_broadcast_rows=MAX_BATCH_KEYS)
            fresh.write.mode("append").parquet(store)
            batch.unpersist()
        finally:
            lines.unpersist()

    return write


def start_ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, key: str = "url",
                 rejects: str | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it processes what has landed and stops. ``rejects`` defaults to the
    store's name with ``_rejects``."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(landing)
    w = lines.writeStream.foreachBatch(append_new(store, rejects or store.rstrip("/") + "_rejects", key)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
