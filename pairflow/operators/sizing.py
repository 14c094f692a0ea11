"""Broadcast of tables whose size was measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pairflow.session import ensure_checkpoint_dir

BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 16


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, checkpointed, and marked for broadcast if its bytes allow it.

    For the small side of a join with the observations: an aggregate, whose size the
    optimizer takes to be that of its input, so that the observations would be
    shuffled for nothing.  A table over the limit is joined as any other.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint()
    _, size = rows_and_bytes(done)
    return F.broadcast(done) if size is not None and size <= limit else done


def rows_and_bytes(df: DataFrame) -> tuple[int, int | None]:
    """Rows of a table and their bytes; none of the latter where a column is nested."""
    width = F.lit(ROW_OVERHEAD)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return df.count(), None
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(16) if text else F.lit(8))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return n, size or 0
