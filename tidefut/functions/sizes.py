"""Tables that are small enough to be sent to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables up to so many bytes of text are sent to all tasks.
SENT_BYTES = 64_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The table marked for sending to all tasks if its values, counted first, are small enough; else as it is."""
    size = F.lit(16)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SENT_BYTES else df
