"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A of the distinct vectors are factored A = Q R without gathering them: each
pass sums Q'Q over the tasks, takes the Cholesky factor of the (shifted, if need be) sum, and
the next pass solves the rows against it.  The factors of all passes compose to R, whose
singular vectors and values are those of A.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.session import ensure_checkpoint_dir

COMPONENTS = 16
SCALE, ORIGIN = 64, 1_000_000
#: Integers beyond it would not be exact as doubles; entries are held within.
LARGEST = 1 << 52
PASSES, FAN = 8, 32
UNIT = np.finfo(float).eps / 2
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows whose vector is finite and of the most frequent length."""
    v = vectors[vector].cast("array<double>")
    whole = vectors.filter(v.isNotNull()).select(vectors[id_col].alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c * float(SCALE)), F.lit(LARGEST - ORIGIN)), F.lit(ORIGIN - LARGEST))
    rows = whole.filter(finite).select("vec_id", F.transform("v", lambda c: held(c) + F.lit(ORIGIN).cast("long")).alias("x"))
    dims = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = dims.select(F.max(F.struct("n", "d"))["d"].alias("d")).scalar()
    return rows.filter((F.size("x") == usual) & (F.size("x") > 0))


def matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """A column of equally long lists as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total: exact whole numbers, as objects where 64 bits are too few."""
    most = int(np.abs(x).max(initial=0))
    if 2 * n * most < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def solved(x: np.ndarray, n: int, total: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Rows of Q: the centred rows times the inverse of the factor so far."""
    return (centred(x, n, total) / n).astype(float) @ inverse


def _gram(n: int, total: np.ndarray, inverse: np.ndarray):
    def run(batches):
        g = np.zeros((inverse.shape[1],) * 2)
        for batch in batches:
            q = solved(matrix(batch.column("x"), np.int64), n, total, inverse)
            g += q.T @ q
        yield pa.RecordBatch.from_pydict({"g": [g.ravel()]}, pa.schema([("g", pa.list_(pa.float64()))]))

    return run


def _sum(table: pa.Table) -> pa.Table:
    rows = matrix(table.column("g"), float)
    rows = rows[np.lexsort(rows.T[:2])]  # in one order, for one result
    return pa.table({"part": table.column("part").slice(0, 1), "g": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def gram(fit: DataFrame, n: int, total: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Q'Q over all rows: one matrix per task, summed up a tree."""
    parts = fit.mapInArrow(_gram(n, total, inverse), "g array<double>").withColumn("part", F.spark_partition_id() % FAN)
    for width in (FAN, 1):
        parts = parts.withColumn("part", F.col("part") % width).groupBy("part").applyInArrow(_sum, "part int, g array<double>")
    k = inverse.shape[1]
    got = parts.select("g").toArrow()
    return matrix(got.column("g"), float).reshape(k, k) if got.num_rows else np.zeros((k, k))


def shifted_cholesky_qr(fit: DataFrame, n: int, total: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """R of the centred rows.  The Gram matrix is shifted until its Cholesky factor exists; passes go on until Q is orthonormal.

    Where the rows do not vary, Q'Q keeps the eigenvalue 0, and R is freed of that direction.
    """
    d = len(total)
    r = np.eye(d)
    for k in range(passes):
        inverse = np.linalg.inv(r)
        g = gram(fit, n, total, inverse)
        g = (g + g.T) / 2
        size, axes = np.linalg.eigh(g)
        if k and np.all((np.abs(size - 1) < 1e-12 * d) | (np.abs(size) < 1e-6)):
            axes = axes[:, size > 0.5]
            return axes @ (axes.T @ r)
        if not size[-1] > 0:
            return np.zeros((d, d))
        shift = min(11 * (n * d + d * (d + 1)) * UNIT, 1e-6) * size[-1] if size[0] < 1e-3 * size[-1] else 0.0
        factor = np.linalg.cholesky(g + shift * np.eye(d)).T
        r = factor @ r
    return r


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance (columns), their eigenvalues falling, and each one's share of the trace.

    Eigenvalues below the accuracy of R are 0.
    """
    _, sigma, v = np.linalg.svd(r)
    sigma = np.where(sigma > sigma.max(initial=0) * 1e-9, sigma, 0.0)
    value = sigma**2 / n
    share = value / value.sum() if value.sum() else value
    return v.T[:, :most], value[:most], share[:most]


def _score(n: int, total: np.ndarray, axes: np.ndarray, value: np.ndarray, share: np.ndarray, error: float | None):
    k = len(value)
    known = value > 0
    scale = np.where(known, 1 / np.sqrt(np.where(known, value, 1.0)), np.nan)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), np.int64)
            off = centred(x, n, total)
            w = (off / n).astype(float) @ axes * scale
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 1 << 63:
                square = (off * off).sum(axis=1).tolist()
            else:
                square = [s if s < 1 << 63 else None for s in (sum(int(c) ** 2 for c in row) for row in off)]
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n, dtype=np.int64)),
                    pa.array(square, pa.int64()).take(pa.array(rows)),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(share, len(x))),
                    pa.array([error] * len(rows), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds null or non-finite entries, or has another
    length than most rows (of equally frequent lengths, the larger counts) are left out.
    The means and components are those of the distinct vectors, so copies do not weigh;
    every row is scored, repeated ones too.  There are ``most`` components, or as many as
    dimensions.  A component without variance has share 0 and a null ``whitened``;
    ``identity_error`` is over the others, null if there is none.  ``deviation`` is null
    where it exceeds a long.  An empty table gives no rows; other columns are not read.

    To the driver come the sums and the matrices of dimension by dimension only.  Runs jobs
    when called.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = integer_vectors(vectors, id_col, vector).checkpoint()
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, {OUT}"
    fit = rows.select("x").distinct().checkpoint()
    totals = fit.select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    sums = sorted(totals.collect())
    if not sums:
        return spark.createDataFrame([], schema)
    n, total = sums[0]["n"], np.array([int(s["s"]) for s in sums], dtype=object)
    axes, value, share = components(shifted_cholesky_qr(fit, n, total), n, most)
    known = value > 0
    error = None
    if known.any():
        white = axes[:, known] / np.sqrt(value[known])
        error = float(np.abs(gram(fit, n, total, white) / n - np.eye(known.sum())).max())
    return rows.mapInArrow(_score(n, total, axes, value, share, error), schema)
