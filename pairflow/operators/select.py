"""Projections, filters and predicates (section 2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import in_range, is_true
from pairflow.schema import COMPOSITION, ENTITY_COLUMNS, FEATURES, ROW_ID, TARGETS, TEMPERATURE


def split_data_features(
    df: DataFrame,
    ids: list[str] = ENTITY_COLUMNS,
    targets: list[str] = TARGETS,
    features: list[str] = FEATURES,
    row_id: str = ROW_ID,
) -> tuple[DataFrame, DataFrame]:
    """Two projections of one table; ``row_id`` ties them together again."""
    return df.select(row_id, *ids, *targets), df.select(row_id, *features)


def suffix_columns(df: DataFrame, suffix: str = "_pred", keep: list[str] = ()) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c if c in keep else c + suffix) for c in df.columns])


def rename_map(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Dictionary rename; names absent from the table are ignored."""
    return df.withColumnsRenamed(names)


def keep_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep those of ``columns`` that exist."""
    return df.select([F.col(f"`{c}`") for c in columns if c in df.columns])


def drop_if_exists(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what does not parse becomes NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns})


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in any of the columns (default: all)."""
    return df.na.drop("any", subset=columns)


def mask_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Blank the rows that satisfy the predicate, then drop them."""
    return df.filter(~is_true(predicate))


def filter_in_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.filter(in_range(F.col(column), lo, hi))


def filter_abs_below(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.filter(F.abs(F.col(column)) < F.lit(float(limit)))


def celsius_to_kelvin(df: DataFrame, column: str, units: str) -> DataFrame:
    """Shift to kelvin when the units are ``"C"``; otherwise leave as is."""
    if units != "C":
        return df
    return df.withColumn(column, F.col(column) + F.lit(fixed.KELVIN_OFFSET))


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def slice_rows(df: DataFrame, start: int = 0, n: int | None = None, index: str = "pair_index") -> DataFrame:
    """Rows whose index is in ``[start, n)``; without ``n``, all from ``start`` on.

    ``n`` is the total to reach, as in a restart: rows already done count towards it.
    """
    out = df.filter(F.col(index) >= F.lit(start))
    return out if n is None else out.filter(F.col(index) < F.lit(n))


def composition_pair(df: DataFrame, x: str = COMPOSITION, x2: str = "x2") -> DataFrame:
    """Add the second mole fraction."""
    return df.withColumn(x2, F.lit(1.0) - F.col(x))


def weights_temperatures(
    df: DataFrame, x: str = COMPOSITION, temperature: str = TEMPERATURE, row_id: str = ROW_ID
) -> tuple[DataFrame, DataFrame]:
    """The (mole fractions, temperature) pair of tables, tied by ``row_id``."""
    both = composition_pair(df, x)
    return both.select(row_id, x, "x2"), df.select(row_id, temperature)
