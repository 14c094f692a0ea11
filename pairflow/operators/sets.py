"""Set operations (section 2.7), sorts and limits (section 2.6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pairflow.schema import ENTITY_COLUMNS, GROUP_KEYS, ROW_ID


def union_tagged(frames: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """Concatenate by column name, each table tagged; absent columns become NULL."""
    tagged = [df.withColumn(name, F.lit(label)) for label, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_distinct(df: DataFrame, columns: list[str] = ENTITY_COLUMNS, name: str = "entity") -> DataFrame:
    """Distinct values over several columns of one scan, missing values left out."""
    values = df.select(F.explode(F.array(*columns)).alias(name))
    return values.filter(F.col(name).isNotNull()).distinct()


def complement(df: DataFrame, chosen: DataFrame, on: str = ROW_ID) -> DataFrame:
    return df.join(chosen.select(on), on, "left_anti")


def sort_scores(df: DataFrame) -> DataFrame:
    return df.orderBy("holdout_set", "model_name")


def worst_or_best_rows(
    df: DataFrame, error: str, n: int, ascending: bool = True, tie: list[str] = (ROW_ID,)
) -> DataFrame:
    """First n complete rows by error (a top-k: no full sort)."""
    key = F.col(error).asc() if ascending else F.col(error).desc()
    return df.na.drop("any").orderBy(key, *tie).limit(n)


def first_n_groups(df: DataFrame, keys: list[str] = GROUP_KEYS, n: int = 5) -> DataFrame:
    """All rows of the first n groups in key order."""
    return df.join(df.select(*keys).distinct().orderBy(*keys).limit(n), keys, "left_semi")


def scan_limit(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*order).limit(n)
