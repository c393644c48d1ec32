"""URL-keyed merging of article batches: keep the first row per key, history first."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Batches with at most this many keys are matched against the store through a
# broadcast of their keys (an ingest micro-batch: about 5 MB of URLs). Larger
# batches are comparable to the store, and a shuffle anti join is cheaper.
MAX_BATCH_KEYS = 50_000


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple. NULL keys form one group.

    ``min_by`` is a partial aggregate, so duplicates collapse inside each map
    task before the shuffle; a key that holds a third of all rows still sends
    only one candidate per task.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def merge_history(history: DataFrame, new: DataFrame, key: str = "url",
                  order: Sequence[str] = (), seq_col: str = "ingest_seq",
                  history_unique: bool = False) -> DataFrame:
    """Union of stored and new rows by column name; per key the stored row wins, then the
    smallest ``order`` within the same batch. ``ingest_seq`` (0 stored, 1 new) is kept.
    NULL keys form one group, like every other key.

    With ``history_unique`` (the store is the output of earlier merges, one row
    per key) the store is not regrouped: only the new batch is deduplicated,
    after a null-safe anti join against the stored keys. Then a run moves the
    store's key column and the new rows through the shuffle instead of every
    stored row.
    """
    h = history.withColumn(seq_col, F.lit(0))
    n = new.withColumn(seq_col, F.lit(1))
    if history_unique:
        fresh = only_new(history, n, key)
        return h.unionByName(keep_first(fresh, key, [seq_col, *order]), allowMissingColumns=True)
    u = h.unionByName(n, allowMissingColumns=True)
    return keep_first(u, key, [seq_col, *order])


def only_new(stored: DataFrame, batch: DataFrame, key: str = "url",
             max_broadcast_rows: int | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet. Keys match null-safely (a stored NULL key
    makes new NULL-key rows duplicates, as in the merge).

    Spark cannot broadcast the left side of an anti join, so the plain
    ``batch ▷ stored`` shuffles every stored key. With ``max_broadcast_rows`` set
    and a batch of at most that many rows (counted, at most that many + 1 —
    cheap when the batch is materialised, as in a streaming micro-batch), the
    batch keys are broadcast into a semi join that picks the stored keys
    occurring in the batch — the store is scanned, not shuffled — and the batch
    is anti-joined with that small result.
    """
    keys = batch.select(F.col(key).alias("_batch_key"))
    s = stored.select(F.col(key).alias("_stored_key"))
    if max_broadcast_rows is not None and keys.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        s = s.join(F.broadcast(keys.distinct()), s["_stored_key"].eqNullSafe(keys["_batch_key"]), "left_semi")
    return batch.join(s, batch[key].eqNullSafe(s["_stored_key"]), "left_anti")
