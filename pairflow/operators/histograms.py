"""Histograms and densities (section 2.4, D13-D16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import nan_to_null
from pairflow.operators.sizing import measured


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin over [lo, hi], the last bin closed.

    The quotient is set right against the bin edges themselves, so that a value on
    an edge always opens the bin to its right.
    """
    step = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide((value - lo) * F.lit(float(bins)), hi - lo)).cast("int")
    k = F.greatest(F.lit(0), F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)))
    down = (value < lo + k * step).cast("int")
    up = ((value >= lo + (k + 1) * step) & (k < bins - 1)).cast("int")
    return k - down + up


def _extent(df: DataFrame, column: str, prefix: str) -> list[Column]:
    return [F.min(column).alias(prefix + "lo"), F.max(column).alias(prefix + "hi")]


def histogram(df: DataFrame, column: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Counts per equal-width bin over each group's own extent, empty bins included."""
    by = list(by)
    values = df.select(*by, nan_to_null(F.col(column).cast("double")).alias("__v")).na.drop("any")
    extents = values.groupBy(*by).agg(*_extent(values, "__v", "__")).filter(F.col("__lo").isNotNull())
    if by:
        extents = measured(extents)
        placed = values.join(extents, by)
        lo, hi = F.col("__lo"), F.col("__hi")
    else:
        ends = extents.select(F.struct("__lo", "__hi")).scalar()
        placed, lo, hi = values, ends.getField("__lo"), ends.getField("__hi")
    counts = placed.groupBy(*by, bin_of(F.col("__v"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = extents.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    return frame.join(counts, by + ["bin"], "left").select(
        *by,
        "bin",
        (F.col("__lo") + F.col("bin") * step).alias("bin_lo"),
        (F.col("__lo") + (F.col("bin") + 1) * step).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def edge_bin(value: Column, edges: list[float]) -> Column:
    """0-based bin among explicit edges; the last is inclusive, outside is NULL."""
    passed = sum(((value >= F.lit(float(e))).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))), passed)


def histogram_edges(
    df: DataFrame, column: str, edges: list[float] = fixed.HISTOGRAM_EDGES, by: list[str] = ()
) -> DataFrame:
    """Counts per explicit bin; values outside the edges are not counted."""
    by = list(by)
    values = df.select(*by, edge_bin(nan_to_null(F.col(column).cast("double")), edges).alias("bin"))
    counts = values.na.drop("any").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    bounds = F.array(
        *[F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("bin_lo"), F.lit(float(b)).alias("bin_hi"))
          for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    )
    groups = df.select(*by).na.drop("any").distinct() if by else df.sparkSession.range(1).select()
    frame = groups.select(*by, F.inline(bounds))
    return frame.join(counts, by + ["bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def histogram_2d(df: DataFrame, cx: str, cy: str, bins: tuple[int, int]) -> DataFrame:
    """Counts of the occupied cells of two equal-width grids."""
    values = df.select(*[nan_to_null(F.col(c).cast("double")).alias(a) for c, a in ((cx, "__x"), (cy, "__y"))]).na.drop("any")
    ends = values.agg(*_extent(values, "__x", "x"), *_extent(values, "__y", "y"))
    e = ends.select(F.struct("xlo", "xhi", "ylo", "yhi")).scalar()
    cell = [
        bin_of(F.col("__x"), e.getField("xlo"), e.getField("xhi"), bins[0]).alias("bin_x"),
        bin_of(F.col("__y"), e.getField("ylo"), e.getField("yhi"), bins[1]).alias("bin_y"),
    ]
    return values.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))


def kde(
    df: DataFrame, column: str, by: list[str], lo: float, hi: float, points: int, bandwidth: float | None = None
) -> DataFrame:
    """Gaussian density per group on a grid, each group normalised alone.

    The default bandwidth is Scott's: sample deviation times ``n ** (-1/5)``.  The
    grid is part of the row, so partial sums per (group, point) are all that moves.
    """
    values = df.select(*by, nan_to_null(F.col(column).cast("double")).alias("__v")).na.drop("any")
    width = F.lit(float(bandwidth)) if bandwidth else F.stddev_samp("__v") * F.pow(F.count("__v").cast("double"), F.lit(-0.2))
    widths = values.groupBy(*by).agg(width.alias("__h")).filter(F.col("__h") > 0)
    step = (hi - lo) / (points - 1)
    gridded = values.join(measured(widths), by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.lit(float(lo)) + F.col("point") * F.lit(step)
    z = (at - F.col("__v")) / F.col("__h")
    height = F.exp(F.lit(-0.5) * z * z) / (F.col("__h") * F.lit((2.0 * 3.141592653589793) ** 0.5))
    return gridded.groupBy(*by, "point", at.alias("x")).agg(F.avg(height).alias("density"))
