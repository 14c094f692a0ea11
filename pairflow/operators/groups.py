"""A user's predictor run per group, with failures reported (I8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from pairflow.functions.scalars import nan_to_null
from pairflow.operators.sizing import measured
from pairflow.schema import GROUP_KEYS, ROW_ID
from pairflow.session import stored

ROWS_PER_TASK = 100_000


def apply_per_group(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    outputs: list[str],
    row_id: str = ROW_ID,
) -> DataFrame:
    """Call ``fn(key, rows)`` on every group; returns rows, outputs, status, error.

    ``fn`` works row by row: it predicts each row from the key and that row's own
    conditions, and returns one output row per input row in the same order.  Rows of a key
    are brought together to make few calls, large groups over several tasks; as results
    are per row, it does not matter in which parts a group comes.  An exception or a result of
    another length fails the whole group: all of its rows come back with NULL outputs,
    ``status`` "error" or "incomplete", and the message.

    The outcome is stored, so that ``fn`` runs once per row although failures
    are then looked up across the parts of a group.
    """
    spark = df.sparkSession
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_TASK)).alias("__parts"))
    part = F.pmod(F.xxhash64(row_id), F.col("__parts")).cast("int")
    parted = df.join(measured(sizes), keys).withColumn("__part", part).drop("__parts")
    # A fixed number of partitions: small ones would be merged, and Python is slow.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered = parted.repartition(n, *keys, "__part").sortWithinPartitions(*keys, "__part").select(df.columns)
    schema = T.StructType(
        list(df.schema.fields)
        + [T.StructField(c, T.DoubleType()) for c in outputs]
        + [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
    )

    def attempt(key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame | None, str, str | None]:
        try:
            found = fn(key, rows)
        except Exception as e:  # the message is the result
            return None, "error", f"{type(e).__name__}: {e}"
        if len(found) != len(rows):
            return None, "incomplete", "fewer results than rows" if len(found) < len(rows) else "more results than rows"
        return found, "ok", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = {c: np.full(len(batch), np.nan) for c in outputs}
            status = np.full(len(batch), "ok", dtype=object)
            error = np.full(len(batch), None, dtype=object)
            for key, at in batch.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                found, status[at], error[at] = attempt(key, batch.iloc[at].reset_index(drop=True))
                if found is not None:
                    for c in outputs:
                        values[c][at] = np.asarray(found[c], dtype=float)
            yield batch.assign(**values, status=status, error=error)

    results = gathered.mapInPandas(run, schema)
    results = stored(results.withColumns({c: nan_to_null(c) for c in outputs}), "predicted")
    return _fail_whole_groups(results, keys, outputs)


def _fail_whole_groups(results: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    failed = (
        results.filter(F.col("status") != "ok")
        .groupBy(*keys)
        .agg(F.max("status").alias("__status"), F.min("error").alias("__error"))
    )
    joined = results.join(measured(failed), keys, "left")
    bad = F.col("__status").isNotNull()
    return joined.withColumns(
        {c: F.when(~bad, F.col(c)) for c in outputs}
        | {"status": F.coalesce("__status", "status"), "error": F.coalesce("__error", "error")}
    ).drop("__status", "__error")


def group_failures(results: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Report: one row per failed group."""
    return (
        results.filter(F.col("status") != "ok")
        .groupBy(*keys)
        .agg(F.min("status").alias("status"), F.min("error").alias("error"), F.count(F.lit(1)).alias("n_rows"))
    )
