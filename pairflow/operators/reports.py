"""Tables behind the usual figures (section 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import abs_error, format_score
from pairflow.operators.aggregates import score_columns, value_counts
from pairflow.operators.histograms import histogram, histogram_edges
from pairflow.operators.joins import join_left_keys
from pairflow.operators.select import cast_numeric, drop_incomplete, filter_abs_below
from pairflow.operators.sets import first_n_groups, union_tagged
from pairflow.schema import COMPOSITION, GROUP_KEYS, ROW_ID, TARGETS


def parity_points(df: DataFrame, targets: list[str] = TARGETS, row_id: str = ROW_ID) -> DataFrame:
    """Long (target, truth, pred) points."""
    points = [
        F.struct(F.lit(t).alias("target"), F.col(t).alias("truth"), F.col(f"{t}_pred").alias("pred")) for t in targets
    ]
    return df.select(row_id, F.inline(F.array(*points)))


def parity_table(df: DataFrame, targets: list[str] = TARGETS, by: list[str] = ()) -> DataFrame:
    """Per target: extent of the parity line and the three score labels."""
    by = list(by)
    ends = [f(t).alias(f"{t}_{n}") for t in targets for n, f in (("lo", F.min), ("hi", F.max))]
    scores = df.groupBy(*by).agg(*ends, *score_columns(targets))
    rows = [
        F.struct(
            F.lit(t).alias("target"),
            F.col(f"{t}_lo").alias("line_min"),
            F.col(f"{t}_hi").alias("line_max"),
            format_score("RMSE", f"{t}_rmse").alias("rmse_label"),
            format_score("MAE", f"{t}_mae").alias("mae_label"),
            format_score("R2", f"{t}_r2").alias("r2_label"),
        )
        for t in targets
    ]
    return scores.select(*by, F.inline(F.array(*rows)))


def error_vs(df: DataFrame, column: str, targets: list[str] = TARGETS) -> DataFrame:
    """Complete rows as (column, absolute error per target)."""
    errors = [abs_error(t, f"{t}_pred").alias(f"abs_error_{i}") for i, t in enumerate(targets, start=1)]
    return df.na.drop("any").select(column, *errors)


def cluster_count_table(df: DataFrame, cluster: str = "cluster", log_scale: bool = False) -> DataFrame:
    """Bar heights, optionally their base-10 logarithm."""
    counts = value_counts(df, cluster, "n")
    return counts.withColumn("height", F.log10("n")) if log_scale else counts


def distribution_compare(
    frames: dict[str, DataFrame], column: str, edges: list[float] = fixed.HISTOGRAM_EDGES
) -> DataFrame:
    """Explicit-edge histogram of each source, over complete rows."""
    both = union_tagged({k: df.select(column) for k, df in frames.items()}, "source")
    return histogram_edges(both, column, edges, by=["source"])


def observed_vs_reference(
    a: DataFrame, b: DataFrame, keys: list[str], float_keys: list[str], targets: list[str] = TARGETS
) -> DataFrame:
    """Scores of one source against another on matching conditions."""
    joined = drop_incomplete(join_left_keys(a, b, keys, float_keys))
    numeric = cast_numeric(joined, targets + [f"{t}_pred" for t in targets])
    return numeric.agg(F.count(F.lit(1)).alias("n"), *score_columns(targets))


def embedding_scatter(scores: DataFrame, value: str, limit: float, columns: list[str]) -> DataFrame:
    """Plot columns of the rows whose colour value is small enough."""
    return filter_abs_below(scores, value, limit).select(*columns, value)


def group_curves(
    df: DataFrame, n: int = 5, keys: list[str] = GROUP_KEYS, x: str = COMPOSITION, targets: list[str] = TARGETS
) -> DataFrame:
    """(group, x, truth, prediction) of the first n groups."""
    pred = [f"{t}_pred" for t in targets]
    return first_n_groups(df, keys, n).select(*keys, x, *targets, *pred).orderBy(*keys, x)


def compare_fits(
    polynomial: DataFrame, nrtl: DataFrame, column: str, limit: float, bins: int = 20, edges: list[float] | None = None
) -> DataFrame:
    """Histogram of the group errors of two models, errors from ``limit`` on left out.

    Each model has its own equal-width bins, unless explicit edges are given.
    """
    both = union_tagged({"NRTL": nrtl.select(column), "Polynomial": polynomial.select(column)}, "model")
    small = both.filter(F.col(column) < limit)
    return histogram(small, column, bins, ["model"]) if edges is None else histogram_edges(small, column, edges, ["model"])
