"""Measured sizes: what may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row, about: texts by their length, nested columns by
    that of their JSON, and 16 a column."""
    out = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return out


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the bytes of all rows of ``df`` (narrow, checkpointed or cheap
    to make) are within ``limit``."""
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return total <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it `is_small`; else Spark joins it by
    shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df
