"""Size-checked broadcast for dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: a dimension is broadcast only when it holds at most this many rows and bytes
MAX_BROADCAST_ROWS = 10_000
MAX_BROADCAST_BYTES = 8 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after proving it small: at most ``max_rows + 1``
    rows are counted (the limit stops the scan early) and measured as JSON text.
    A larger input is returned as is, leaving the join strategy to Spark's size
    check and AQE."""
    size = F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns])))
    rows, measured = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if rows <= max_rows and (measured or 0) <= max_bytes else df
