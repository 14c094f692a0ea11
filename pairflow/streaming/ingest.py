"""Incremental parsing of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairflow.sources.blocks import stream_block_text


def ingest_blocks_incremental(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    ids: str = "file",
    strict: bool = True,
) -> DataFrame:
    """Parse result files not seen before and append them once; returns all so far.

    Runs over what is there and stops.  The checkpoint remembers the files done, so
    the next call, or a call after a failure, goes on from there.
    """
    blocks = stream_block_text(spark, path, ids, strict)
    writer = blocks.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(blocks.schema).parquet(out)
