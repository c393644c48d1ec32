"""Join helpers: broadcast only what is checked to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size up to which a lookup table is shipped to every task instead of shuffled.
MAX_BROADCAST_BYTES = 32 << 20


def table_bytes(df: DataFrame, limit_rows: int = 1_000_000) -> int | None:
    """Bytes of the rows written as JSON (an upper bound of what a broadcast holds of them, arrays included), or None
    past ``limit_rows`` rows."""
    n, size = df.limit(limit_rows + 1).agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return size if n <= limit_rows else None


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left", max_bytes: int = MAX_BROADCAST_BYTES,
                known_rows: int | None = None) -> DataFrame:
    """Join ``df`` with a lookup table; it is broadcast only if its rows take at most ``max_bytes``.

    The check reads the table once (a small job on a dimension; pass a checkpointed one if it is derived). A caller
    that can prove a small number of narrow rows (a fixed list, one row per cluster) passes it as ``known_rows`` and
    the check is skipped. Past the bound the join stays a shuffle join.
    """
    if known_rows is not None:
        return df.join(F.broadcast(dim), on, how)
    size = table_bytes(dim)
    return df.join(F.broadcast(dim) if size is not None and size <= max_bytes else dim, on, how)
