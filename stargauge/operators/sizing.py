"""Whether a join side may be broadcast: checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 16 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the whole frame stays below both bounds; reads ``max_rows + 1`` rows at most."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), size).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes
