"""Running coverage counts per time window, topic and leaning: exact per-batch counts, added up on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def article_ts(datetime_col: str = "datetime") -> F.Column:
    """Event time of the compact ``yyyyMMddHHmmss`` text (8-digit dates are midnight).

    The wall-clock fields are read as UTC, so the instant is the same in every
    session time zone and tumbling windows, which Spark aligns at UTC
    midnight, are the calendar days of the text. Other text, or impossible
    dates, give NULL.
    """
    c = F.col(datetime_col)
    # The two parses validate the text (digits, field ranges) as before; the
    # instant is then built from the text's own fields, so it does not depend
    # on the session zone (a DATE has none).
    full_ok = F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")).isNotNull()
    day_ok = F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull()

    def field(pos: int) -> F.Column:
        return F.substring(c, pos, 2).try_cast("long")

    day = F.unix_date(F.try_to_date(F.substring(c, 1, 8), "yyyyMMdd")).cast("long") * 86400
    seconds = F.when(full_ok, day + field(9) * 3600 + field(11) * 60 + field(13)).when(day_ok, day)
    return F.timestamp_seconds(seconds)


def utc_day(ts_col) -> F.Column:
    """Calendar day (UTC) of an instant, independent of the session time zone."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / F.lit(86400)).cast("int"))


def coverage_windows(df: DataFrame, ts_col: str = "ts", window: str = "1 day") -> DataFrame:
    """Articles per tumbling window, topic and leaning.

    Calendar months are not fixed-length windows; monthly series stay batch (``date_trunc``) queries.
    """
    g = df.where(F.col("topic").isNotNull()).groupBy(F.window(ts_col, window).alias("w"), "topic", "pol_leaning") \
        .agg(F.count("*").alias("n_articles"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "topic", "pol_leaning", "n_articles")


def start_coverage(rows: DataFrame, sink: str, checkpoint: str, ts_col: str = "ts", window: str = "1 day",
                   available_now: bool = True):
    """Write running coverage counts of a stream of articles, without leaving out late rows.

    Every micro-batch writes its own counts as one partition of the sink, named by the batch id: a replayed batch
    overwrites its partition. `read_coverage` adds the partitions up. No state is kept between batches, and a
    row counts whenever it arrives.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        coverage_windows(batch, ts_col, window).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_coverage(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of all micro-batches, added up per window, topic and leaning: equal to `coverage_windows` over all
    rows that have arrived."""
    keys = ["window_start", "window_end", "topic", "pol_leaning"]
    return spark.read.parquet(sink).groupBy(*keys).agg(F.sum("n_articles").alias("n_articles"))


def compact_coverage(spark: SparkSession, sink: str, target: str) -> None:
    """Write the added-up counts as one table elsewhere, for a sink of very many batches."""
    read_coverage(spark, sink).write.mode("overwrite").parquet(target)
