"""Aggregations (section 2.4): every one combines on the map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import abs_error, all_of, in_range, is_true, nan_to_null, round4
from pairflow.operators.ordering import first_per_key
from pairflow.operators.sizing import measured
from pairflow.schema import GROUP_KEYS, TARGETS


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Count per value, most frequent first; missing values are not counted."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), column)


def group_max_sorted(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    largest = F.max(nan_to_null(value)).alias(name)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(largest).orderBy(F.desc(name), key)


def group_mean(df: DataFrame, keys: list[str] = GROUP_KEYS, columns: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column per group, missing values skipped."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    if columns is None:
        columns = [c for c, t in df.dtypes if t in numeric and c not in keys]
    means = [F.avg(nan_to_null(F.col(c).cast("double"))).alias(c) for c in columns]
    return df.na.drop("any", subset=keys).groupBy(*keys).agg(*means)


def limit_groups(df: DataFrame, keys: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Keep whole groups whose every target lies in its half-open range.

    The surviving keys are aggregated on the map side and joined back, by broadcast
    if they turn out small; an empty outcome is an empty table.
    """
    inside = all_of([in_range(c, lo, hi) for c, (lo, hi) in bounds.items()])
    good = (
        df.na.drop("any", subset=keys)
        .groupBy(*keys)
        .agg(F.bool_and(inside).alias("__good"))
        .filter("__good")
        .select(*keys)
    )
    return df.join(measured(good), keys, "left_semi")


def group_sizes(df: DataFrame, keys: list[str] = GROUP_KEYS, n: int = fixed.MIN_GROUP_ROWS) -> DataFrame:
    """Rows per group and whether the group is big enough; the skip report."""
    sizes = df.na.drop("any", subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("skipped", F.col("n") < n)


def min_group_size(df: DataFrame, keys: list[str] = GROUP_KEYS, n: int = fixed.MIN_GROUP_ROWS) -> DataFrame:
    """Drop groups of fewer than n rows."""
    enough = group_sizes(df, keys, n).filter(~F.col("skipped")).select(*keys)
    return df.join(measured(enough), keys, "left_semi")


def score_columns(targets: list[str] = TARGETS, suffix: str = "_pred") -> list[Column]:
    """RMSE, MAE and R2 aggregates per target.

    All three are over the rows that have both truth and prediction.  R2 is one minus
    residual over total sum of squares; for constant truth it is 1 when every prediction
    is right and 0 otherwise.
    """
    rmse, mae, r2 = [], [], []
    for t in targets:
        y, p = nan_to_null(t), nan_to_null(t + suffix)
        residual = F.sum((y - p) * (y - p))
        spread = F.regr_syy(y, p)  # rows with both
        constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        share = F.when(spread == 0, constant).otherwise(F.lit(1.0) - F.try_divide(residual, spread))
        rmse.append(F.sqrt(F.avg((y - p) * (y - p))).alias(f"{t}_rmse"))
        mae.append(F.avg(abs_error(y, p)).alias(f"{t}_mae"))
        r2.append(share.alias(f"{t}_r2"))
    return rmse + mae + r2


def regression_scores(df: DataFrame, targets: list[str] = TARGETS, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*score_columns(targets))


def scores_by_holdout(
    df: DataFrame,
    targets: list[str] = TARGETS,
    by: tuple[str, str] = ("holdout_set", "model_name"),
    drop_na: bool = True,
) -> DataFrame:
    """All scores of all models and holdouts in one grouped aggregate, 4 places."""
    if drop_na:
        df = df.na.drop("any", subset=targets + [t + "_pred" for t in targets])
    scores = regression_scores(df, targets, list(by))
    names = [f"{t}_{m}" for m in ("rmse", "mae", "r2") for t in targets]
    return scores.withColumns({c: round4(c) for c in names}).orderBy(*by)


def mae(df: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str] = ()) -> DataFrame:
    """Mean absolute error per named (truth, prediction) pair."""
    return df.groupBy(*by).agg(*[F.avg(abs_error(y, p)).alias(k) for k, (y, p) in pairs.items()])


def low_cardinality_profile(df: DataFrame, limit: int = 10) -> DataFrame:
    """Values of every column with fewer than ``limit`` distinct ones, NULL counted.

    A sketch picks the candidates: with few distinct values it counts the filled
    registers, never above the true number by more than rounding, so no column is
    lost.  Only the candidates' values are then made distinct exactly.
    """
    sketch = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in df.columns])
    estimates = sketch.first().asDict()
    candidates = [c for c in df.columns if estimates[c] < 2 * limit]
    if not candidates:
        return df.sparkSession.createDataFrame([], "column string, value string")
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in candidates
    ]
    values = df.select(F.inline(F.array(*cells))).distinct()
    few = values.groupBy("column").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < limit)
    return values.join(few.select("column"), "column", "left_semi")


def fraction_where(df: DataFrame, predicate: Column, by: list[str] = (), name: str = "fraction") -> DataFrame:
    """Share of rows that satisfy the predicate; NULL counts as no."""
    return df.groupBy(*by).agg(F.avg(is_true(predicate).cast("double")).alias(name))


def min_max(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    ends = [f(nan_to_null(F.col(c))).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*ends)


def dedup_subset(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Drop duplicates, keeping the first in the given order; NULL equals NULL."""
    if columns is None:
        return df.distinct()
    if order is None:
        return df.dropDuplicates(columns)
    return first_per_key(df, columns, order)


def split_sizes(df: DataFrame, entity_columns: list[str], by: str = "split") -> DataFrame:
    """Rows and distinct entities per split."""
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    entities = (
        df.select(by, F.explode(F.array(*entity_columns)).alias("__entity"))
        .distinct()
        .groupBy(by)
        .agg(F.count("__entity").alias("n_entities"))
    )
    return rows.join(entities, by)


def all_in_range(df: DataFrame, columns: list[str], lo: float, hi: float, name: str = "all_in_range") -> DataFrame:
    """One boolean: is every value of the table within the half-open range?"""
    inside = all_of([in_range(c, lo, hi) for c in columns])
    return df.agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def column_residual_norm(df: DataFrame, columns: list[str], by: list[str] = (), name: str = "norm") -> DataFrame:
    """Largest value over all rows and over the columns."""
    return df.groupBy(*by).agg(F.greatest(*[F.max(nan_to_null(c)) for c in columns]).alias(name))
