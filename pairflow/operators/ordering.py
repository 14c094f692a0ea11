"""Operators that depend on order (section 2.5), without global windows on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairflow.functions.scalars import hash_fraction, seeded_hash
from pairflow.operators.sizing import measured
from pairflow.schema import ROW_ID
from pairflow.session import stored

# Hex digits of the hash histogram: at most 16**5 rows meet in the small window,
# and about n / 16**5 rows remain to be ranked in the cut bucket.
PREFIX_DIGITS = 5


def row_index(df: DataFrame, order: list[str | Column], name: str = "row_index") -> DataFrame:
    """Dense 0-based index in the given total order.

    The rows are range-partitioned, numbered within their partition, and shifted by
    the number of rows in the partitions before.  The numbered rows are stored
    so that both passes see one and the same partitioning.
    """
    numbered = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"__pid": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()})
        .withColumn("__pos", F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    sizes = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")
    offsets = sizes.select("__pid", before.alias("__offset"))
    indexed = numbered.join(measured(offsets), "__pid").withColumn(name, F.col("__offset") + F.col("__pos"))
    return indexed.drop("__pid", "__pos", "__offset")


def batch_id(df: DataFrame, size: int, index: str = "row_index", name: str = "batch_id") -> DataFrame:
    """Number of the batch of ``size`` consecutive rows a row belongs to."""
    return df.withColumn(name, F.floor(F.col(index) / F.lit(size)).cast("long"))


def fraction_threshold(df: DataFrame, keep: float, seed: int, row_id: str = ROW_ID) -> Column:
    """Hash of the last row of the exact ``int(keep * n)`` rows of smallest hash.

    A scalar subquery, NULL when no row is kept: ``hash <= threshold`` selects the
    sample in one map pass.  First the rows are counted per hash prefix, then only
    the rows of the prefix where the count is reached are ranked.
    """
    hashed = df.select(seeded_hash(row_id, seed).alias("__hash")).withColumn(
        "__prefix", F.substring("__hash", 1, PREFIX_DIGITS)
    )
    counts = hashed.groupBy("__prefix").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__prefix"))
    total = F.sum("__n").over(Window.partitionBy())
    wanted = F.floor(F.lit(float(keep)) * F.col("__total")).cast("long")
    cut = (
        counts.select("__prefix", "__n", upto.alias("__upto"), total.alias("__total"))
        .withColumn("__rank", wanted - (F.col("__upto") - F.col("__n")))
        .filter((F.col("__rank") > 0) & (F.col("__rank") <= F.col("__n")))
        .select(F.struct("__prefix", "__rank").alias("cut"))
        .scalar()
    )
    ranked = hashed.filter(F.col("__prefix") == cut.getField("__prefix")).withColumn(
        "__position", F.row_number().over(Window.orderBy("__hash"))
    )
    return ranked.filter(F.col("__position") == cut.getField("__rank")).select("__hash").scalar()


def holdout_fraction(
    df: DataFrame, fraction: float, seed: int = 1995, row_id: str = ROW_ID, name: str = "part"
) -> DataFrame:
    """Tag exactly ``int((1 - fraction) * n)`` rows "train", the rest "valid_cont"."""
    threshold = fraction_threshold(df, 1.0 - fraction, seed, row_id)
    kept = F.coalesce(seeded_hash(row_id, seed) <= threshold, F.lit(False))
    return df.withColumn(name, F.when(kept, "train").otherwise("valid_cont"))


def random_split(
    df: DataFrame,
    weights: dict[str, float],
    seed: int = 0,
    row_id: str = ROW_ID,
    name: str = "part",
) -> DataFrame:
    """Row-level split by hash fraction; stable under any partitioning."""
    total = sum(weights.values())
    fraction = hash_fraction(row_id, seed)
    labels = list(weights)
    chosen = F.lit(labels[-1])
    bounds, upper = [], 0.0
    for label in labels[:-1]:
        upper += weights[label] / total
        bounds.append((label, upper))
    for label, bound in reversed(bounds):
        chosen = F.when(fraction < F.lit(bound), label).otherwise(chosen)
    return df.withColumn(name, chosen)


def shuffle(df: DataFrame, seed: int, row_id: str = ROW_ID) -> DataFrame:
    """Whole table in a seeded random order (a distributed range sort)."""
    return df.orderBy(seeded_hash(row_id, seed), row_id)


def shuffled_index(df: DataFrame, seed: int, row_id: str = ROW_ID, name: str = "shuffled_index") -> DataFrame:
    """Position of every row in the seeded random order."""
    return row_index(df, [seeded_hash(row_id, seed), F.col(row_id)], name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key; each map task passes on at most one row per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")
