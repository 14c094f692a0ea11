"""Grouped curve fits from sufficient statistics (section 2.9).

The rows of a group are never gathered: they are first reduced to one row per
distinct composition (count, mean and squared deviation of each target), combined
on the map side, and every fit below works on those levels.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.models import nrtl_from_factors, nrtl_ln_gamma, polynomial
from pairflow.functions.scalars import abs_error, nan_to_null
from pairflow.operators.sizing import measured
from pairflow.schema import COMPOSITION, GROUP_KEYS, TARGETS, coefficient_names
from pairflow.session import ensure_checkpoint_dir


def level_statistics(
    df: DataFrame,
    keys: list[str] = GROUP_KEYS,
    x: str = COMPOSITION,
    targets: dict[str, Column | str] | list[str] = TARGETS,
) -> DataFrame:
    """Per group and composition: ``n_i``, ``mean_i`` and ``ss_i`` of target i."""
    exprs = targets.values() if isinstance(targets, dict) else targets
    columns = {f"__y{i}": nan_to_null(F.col(y) if isinstance(y, str) else y) for i, y in enumerate(exprs)}
    rows = df.na.drop("any", subset=keys + [x]).select(*keys, x, *[c.alias(a) for a, c in columns.items()])
    stats = []
    for i, a in enumerate(columns):
        stats += [
            F.count(a).alias(f"n_{i}"),
            F.avg(a).alias(f"mean_{i}"),
            F.coalesce(F.regr_syy(a, a), F.lit(0.0)).alias(f"ss_{i}"),
        ]
    return rows.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n_rows"), *stats)


def _moments(degree: int, n_targets: int, u: Column) -> list[Column]:
    """Weighted power sums of the levels for the normal equations of every target."""
    out = [F.sum("n_rows").alias("n_rows")]
    for i in range(n_targets):
        n, mean = F.col(f"n_{i}").cast("double"), F.coalesce(F.col(f"mean_{i}"), F.lit(0.0))
        powers = [n]
        for _ in range(2 * degree):
            powers.append(powers[-1] * u)
        out.append(F.sum(F.col(f"n_{i}")).alias(f"n_{i}"))
        out.append(F.count(F.when(F.col(f"n_{i}") > 0, F.lit(1))).alias(f"levels_{i}"))
        out += [F.sum(p).alias(f"__s{i}_{k}") for k, p in enumerate(powers)]
        out += [F.sum(p * mean).alias(f"__t{i}_{k}") for k, p in enumerate(powers[: degree + 1])]
    return out


def _solver(degree: int):
    """Arrow-batched solution of the normal equations, all rows of a batch at once.

    As one expression the elimination outgrows what the JVM compiles, and then costs
    far more than handing 3 * degree + 2 doubles per group to numpy.
    """
    m = degree + 1

    def solve(*columns: pd.Series) -> pd.DataFrame:
        sums = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        s, b = sums[:, : 2 * m - 1], sums[:, 2 * m - 1 :].copy()
        a = np.stack([s[:, r : r + m] for r in range(m)], axis=1)
        with np.errstate(all="ignore"):  # singular rows are told apart by their status
            for k in range(m - 1):
                factor = a[:, k + 1 :, k] / a[:, k, k][:, None]
                a[:, k + 1 :] -= factor[:, :, None] * a[:, k][:, None, :]
                b[:, k + 1 :] -= factor * b[:, k][:, None]
            for r in reversed(range(m)):
                known = (a[:, r, r + 1 :] * b[:, r + 1 :]).sum(axis=1)
                b[:, r] = (b[:, r] - known) / a[:, r, r]
        return pd.DataFrame({f"b{j}": b[:, j] for j in range(m)})

    return F.pandas_udf(solve, ", ".join(f"b{j} double" for j in range(m)))


def _solve(df: DataFrame, degree: int, n_targets: int) -> DataFrame:
    """Solve the normal equations of every target; the result is ``__b{i}.b{j}``."""
    solve = _solver(degree)
    names = lambda i: [f"__s{i}_{k}" for k in range(2 * degree + 1)] + [f"__t{i}_{k}" for k in range(degree + 1)]
    return df.withColumns({f"__b{i}": solve(*names(i)) for i in range(n_targets)})


def _expand(b: list[Column], scale: float, shift: float) -> list[Column]:
    """Coefficients in x of ``sum b[j] * (scale * x - shift) ** j``."""
    d = len(b)
    out = []
    for m in range(d):
        terms = [b[j] * F.lit(float(comb(j, m) * (-shift) ** (j - m) * scale**m)) for j in range(m, d)]
        total = terms[-1]
        for t in reversed(terms[:-1]):
            total = total + t
        out.append(total)
    return out


def fit_polynomial(
    df: DataFrame,
    keys: list[str] = GROUP_KEYS,
    degree: int = fixed.POLYNOMIAL_DEGREE,
    x: str = COMPOSITION,
    targets: list[str] = TARGETS,
    min_rows: int = fixed.MIN_GROUP_ROWS,
    scale: float = 10.0,
    shift: float = 5.0,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Least-squares polynomial per group and target: ``c{j}_{i}`` and ``status_{i}``.

    Groups of fewer than ``min_rows`` rows are left out (see ``group_sizes``).  A
    target with fewer rows than coefficients is "too_few", one with fewer distinct
    compositions is "rank_deficient"; both keep NULL coefficients.  The equations
    are set up in ``scale * x - shift``, which is centred on [0, 1] and exact on a
    grid of tenths.
    """
    levels = level_statistics(df, keys, x, targets) if levels is None else levels
    n = len(targets)
    u = F.col(x) * F.lit(scale) - F.lit(shift)
    sums = levels.groupBy(*keys).agg(*_moments(degree, n, u)).filter(F.col("n_rows") >= min_rows)
    solved = _solve(sums, degree, n)
    out = []
    for i in range(n):
        status = (
            F.when(F.col(f"n_{i}") < degree + 1, "too_few")
            .when(F.col(f"levels_{i}") < degree + 1, "rank_deficient")
            .otherwise("ok")
        )
        cs = _expand([F.col(f"__b{i}.b{j}") for j in range(degree + 1)], scale, shift)
        out.append(F.col(f"n_{i}"))
        out.append(status.alias(f"status_{i}"))
        out += [F.when(status == "ok", c).alias(f"c{j}_{i}") for j, c in enumerate(cs)]
    return solved.select(*keys, "n_rows", *out)


def fit_statistics(
    fits: DataFrame,
    levels: DataFrame,
    keys: list[str] = GROUP_KEYS,
    degree: int = fixed.POLYNOMIAL_DEGREE,
    x: str = COMPOSITION,
    n_targets: int = 2,
) -> DataFrame:
    """Add ``chisqr_i``, ``aic_i`` and ``bic_i`` to fitted groups.

    The squared residual of a level is its own squared deviation plus that of its
    mean from the curve.  Undefined statistics are NULL.
    """
    names = [f"c{j}_{i}" for i in range(n_targets) for j in range(degree + 1)]
    joined = levels.join(fits.select(*keys, *names), keys)
    sums = []
    for i in range(n_targets):
        curve = polynomial(x, [f"c{j}_{i}" for j in range(degree + 1)])
        miss = F.col(f"mean_{i}") - curve
        residual = F.when(F.col(f"n_{i}") > 0, F.col(f"ss_{i}") + F.col(f"n_{i}") * miss * miss)
        sums.append(F.sum(residual).alias(f"chisqr_{i}"))
    out = fits.join(joined.groupBy(*keys).agg(*sums), keys)
    p = degree + 1
    for i in range(n_targets):
        n = F.col(f"n_{i}").cast("double")
        mean = F.try_divide(F.col(f"chisqr_{i}"), n)
        likelihood = F.when(mean > 0, n * F.ln(mean))
        out = out.withColumns(
            {f"aic_{i}": likelihood + F.lit(2.0 * p), f"bic_{i}": likelihood + F.lit(float(p)) * F.ln(n)}
        )
    return out


def widen_coefficients(
    fits: DataFrame,
    keys: list[str],
    target: str,
    coefficients: str,
    n_targets: int = 2,
    degree: int = fixed.POLYNOMIAL_DEGREE,
) -> DataFrame:
    """One row per (group, target) with a coefficient array -> ``c{j}_{i}`` columns.

    The index i is the target itself, so a failed target leaves NULLs, not a shift.
    """
    columns = [
        F.max(F.when(F.col(target) == i, F.get(F.col(coefficients), F.lit(j)))).alias(f"c{j}_{i}")
        for i in range(n_targets)
        for j in range(degree + 1)
    ]
    return fits.groupBy(*keys).agg(*columns)


def lengthen_coefficients(
    fits: DataFrame, keys: list[str] = GROUP_KEYS, n_targets: int = 2, degree: int = fixed.POLYNOMIAL_DEGREE
) -> DataFrame:
    """Inverse of ``widen_coefficients``: (keys, target, coefficients)."""
    rows = [
        F.struct(F.lit(i).alias("target"), F.array(*[f"c{j}_{i}" for j in range(degree + 1)]).alias("coefficients"))
        for i in range(n_targets)
    ]
    return fits.select(*keys, F.inline(F.array(*rows)))


def polynomial_split_tables(
    fits: DataFrame,
    splits: DataFrame,
    keys: list[str] = GROUP_KEYS,
    split: str = "split",
    dedupe: str = "key",
) -> DataFrame:
    """Coefficients of the groups that occur in each split.

    ``dedupe="key"`` gives one row per (split, group); ``"row"`` one per distinct row
    of the split table, as when duplicates are dropped over all its columns.
    """
    if dedupe not in ("key", "row"):
        raise ValueError(f"dedupe must be 'key' or 'row', not {dedupe!r}")
    members = splits.select(split, *keys).distinct() if dedupe == "key" else splits.distinct()
    names = [c for c in coefficient_names() if c in fits.columns]
    return members.join(fits.select(*keys, *names), keys).select(split, *keys, *names)


def eval_polynomial(
    df: DataFrame,
    order: int = fixed.POLYNOMIAL_DEGREE,
    basis: str = "x",
    x: str = COMPOSITION,
    suffix: str = "",
    targets: list[str] = TARGETS,
) -> DataFrame:
    """Add ``{target}_pred`` from the coefficient columns.

    ``basis="one_minus_x"`` evaluates the second target at ``1 - x``.
    """
    if basis not in ("x", "one_minus_x"):
        raise ValueError(f"unknown basis {basis!r}")
    out = {}
    for i, t in enumerate(targets):
        at = F.lit(1.0) - F.col(x) if i == 1 and basis == "one_minus_x" else F.col(x)
        out[f"{t}_pred"] = polynomial(at, [f"c{j}_{i}{suffix}" for j in range(order + 1)])
    return df.withColumns(out)


# --- two-liquid model ---------------------------------------------------------

NRTL_PARAMETERS = ["a12", "a21", "t12", "t21"]
# Half the gaps between these, and to the bounds 0 and 1, add up to the whole range.
ALPHA_AXIS = [0.1, 0.4, 0.8]
TAU_AXIS = [-366.0, -100.0, -30.0, -10.0, -3.0, -1.0, -0.3, 0.0, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 366.0]
GRID_BLOCKS = 16
REFINE_STEPS = [-1.0, -0.5, 0.0, 0.5, 1.0]


def _at(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def _digit(grid: Column, base: int, size: int) -> Column:
    return F.pmod(F.floor(grid / F.lit(base)), F.lit(size))


def _half_gap(axis: list[float], bounds: tuple[float, float]) -> list[float]:
    """Half the wider gap to a neighbour: the first refinement step round a value."""
    ends = [bounds[0], *axis, bounds[1]]
    return [max(b - a, c - b) / 2 for a, b, c in zip(ends, ends[1:], ends[2:])]


def _objective(i1: tuple[str, str, str], prediction: Column) -> Column:
    """Squared residuals of one level against a prediction."""
    n, mean, ss = (F.col(c) for c in i1)
    miss = prediction - mean
    return F.when(n > 0, ss + n * miss * miss).otherwise(F.lit(0.0))


def _best(
    levels: DataFrame, keys: list[str], x: str, n_points: int, parameters: dict[str, Column], objective: str, winners: int = 1
) -> DataFrame:
    """Best grid point per group: ``(keys, grid, cost)``; of more ``winners``, each is the best of a block of the grid.

    Levels are copied once per block of grid points and partitioned on (group,
    block); points are spread out and summed within the task, so only one winner per
    (group, block) is shuffled, and a group of very many levels still runs in as
    many tasks as there are blocks.  Every intermediate is its own projection, which
    keeps the generated code small enough to be compiled.
    """
    blocks_used = min(GRID_BLOCKS, n_points)
    size = -(-n_points // blocks_used)
    blocks = levels.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks_used - 1))))
    blocks = blocks.repartition(*keys, "__block")
    first = F.col("__block") * F.lit(size)
    points = blocks.withColumn("grid", F.explode(F.sequence(first, first + F.lit(size - 1)))).filter(F.col("grid") < n_points)
    points = points.withColumns(parameters)
    points = points.withColumns(
        {
            "__g12": F.exp(-F.col("a12") * F.col("t12")),
            "__g21": F.exp(-F.col("a21") * F.col("t21")),
            "__x2": F.lit(1.0) - F.col(x),
        }
    )
    f1, f2 = nrtl_from_factors(*(F.col(c) for c in ("__g12", "__g21", "t12", "t21", x, "__x2")))
    points = points.withColumns({"__f1": f1, "__f2": f2})
    if objective == "stacked":
        cost = _objective(("n_0", "mean_0", "ss_0"), F.col("__f1")) + _objective(("n_1", "mean_1", "ss_1"), F.col("__f2"))
    else:
        cost = _objective(("n_2", "mean_2", "ss_2"), F.col("__f1") + F.col("__f2"))
    summed = points.groupBy(*keys, "__block", "grid").agg(F.sum(cost).alias("cost"))
    rank = F.rint(F.col("cost") * F.lit(1e9))
    ranked = F.struct(rank.alias("rank"), "grid", "cost")
    if winners > 1:
        each = summed.groupBy(*keys, "__block").agg(F.min(ranked).alias("__best"))
        ordered = F.slice(F.sort_array(F.collect_list("__best")), 1, winners)
        return each.groupBy(*keys).agg(ordered.alias("__best")).select(*keys, F.inline("__best")).drop("rank")
    return summed.groupBy(*keys).agg(F.min(ranked).alias("__best")).select(*keys, "__best.grid", "__best.cost")


def nrtl_levels(df: DataFrame, keys: list[str], x: str, targets: list[str]) -> DataFrame:
    """Level statistics of the two targets (0, 1) and of their sum (2)."""
    y1, y2 = targets
    return level_statistics(df, keys, x, {"1": y1, "2": y2, "sum": F.col(y1) + F.col(y2)})


def _grid(single_alpha: bool, alpha_axis: list[float], tau_axis: list[float]) -> tuple[int, list[Column], dict[str, Column]]:
    """Number of grid points, and from the column ``grid`` the places on the axes and the parameters."""
    na, nt = len(alpha_axis), len(tau_axis)
    grid, a21_size = F.col("grid"), 1 if single_alpha else na
    i_t21, i_t12 = _digit(grid, 1, nt), _digit(grid, nt, nt)
    i_a21, i_a12 = _digit(grid, nt * nt, a21_size), _digit(grid, nt * nt * a21_size, na)
    if single_alpha:
        i_a21 = i_a12
    values = [_at(alpha_axis, i_a12), _at(alpha_axis, i_a21), _at(tau_axis, i_t12), _at(tau_axis, i_t21)]
    return na * a21_size * nt * nt, [i_a12, i_a21, i_t12, i_t21], dict(zip(NRTL_PARAMETERS, values))


def grid_winners(
    levels: DataFrame, keys: list[str], x: str, objective: str, single_alpha: bool, alpha_axis: list[float], tau_axis: list[float], winners: int
) -> DataFrame:
    """Parameters of the best grid points per group, best first: ``(keys, starts)``."""
    n_points, _, parameters = _grid(single_alpha, alpha_axis, tau_axis)
    best = _best(levels, keys, x, n_points, parameters, objective, winners).withColumns(parameters)
    listed = F.sort_array(F.collect_list(F.struct(F.rint(F.col("cost") * F.lit(1e9)).alias("r"), "grid", F.array(*NRTL_PARAMETERS).alias("p"))))
    return best.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.col("l.p").alias("starts"))


def fit_nrtl_grid(
    df: DataFrame,
    keys: list[str] = GROUP_KEYS,
    x: str = COMPOSITION,
    targets: list[str] = TARGETS,
    objective: str = "stacked",
    single_alpha: bool = False,
    alpha_axis: list[float] = ALPHA_AXIS,
    tau_axis: list[float] = TAU_AXIS,
    refinements: int = 1,
) -> DataFrame:
    """Two-liquid parameters per group by grid search and refinement round the winner.

    ``objective="stacked"`` minimises ``r1**2 + r2**2``; ``"sum"`` minimises
    ``(r1 + r2)**2``, where opposite errors cancel.  Costs are compared at nine
    decimals, and equal ones go to the earlier grid point.
    """
    if objective not in ("stacked", "sum"):
        raise ValueError(f"unknown objective {objective!r}")
    levels = nrtl_levels(df, keys, x, targets)
    if refinements:  # read again by every round
        ensure_checkpoint_dir(df.sparkSession)
        levels = levels.checkpoint()
    n_points, digits, parameters = _grid(single_alpha, alpha_axis, tau_axis)
    alpha_gap, tau_gap = _half_gap(alpha_axis, fixed.ALPHA_BOUNDS), _half_gap(tau_axis, fixed.TAU_BOUNDS)
    i_a12, i_a21, i_t12, i_t21 = digits
    steps = {
        "h_a12": _at(alpha_gap, i_a12), "h_a21": _at(alpha_gap, i_a21), "h_t12": _at(tau_gap, i_t12), "h_t21": _at(tau_gap, i_t21),
    }
    best = _best(levels, keys, x, n_points, parameters, objective).withColumns(parameters | steps)
    for _ in range(refinements):
        best = _refine(levels, best, keys, x, objective, single_alpha)
    return best.select(*keys, *NRTL_PARAMETERS, F.col("cost").alias("objective"))


def _refine(levels: DataFrame, best: DataFrame, keys: list[str], x: str, objective: str, single_alpha: bool) -> DataFrame:
    """Search the neighbourhood of each group's winner, then halve the steps."""
    s = len(REFINE_STEPS)
    centre = {p: f"__c_{p}" for p in NRTL_PARAMETERS}
    steps = {p: f"h_{p}" for p in NRTL_PARAMETERS}
    around = best.select(*keys, *[F.col(p).alias(c) for p, c in centre.items()], *steps.values())
    bases = {"t21": 1, "t12": s, "a21": s * s, "a12": s**3}
    if single_alpha:
        bases["a12"] = bases["a21"]
    n_points = s**3 if single_alpha else s**4
    parameters = {}
    for p in NRTL_PARAMETERS:
        lo, hi = fixed.ALPHA_BOUNDS if p.startswith("a") else fixed.TAU_BOUNDS
        moved = F.col(centre[p]) + F.col(steps[p]) * _at(REFINE_STEPS, _digit(F.col("grid"), bases[p], s))
        parameters[p] = F.greatest(F.lit(lo), F.least(F.lit(hi), moved))
    found = _best(levels.join(around, keys), keys, x, n_points, parameters, objective)
    placed = found.join(around, keys).withColumns(parameters)
    return placed.withColumns({h: F.col(h) * F.lit(0.5) for h in steps.values()}).drop(*centre.values())


def evaluate_nrtl(
    df: DataFrame,
    parameters: DataFrame,
    keys: list[str] = GROUP_KEYS,
    x: str = COMPOSITION,
    targets: list[str] = TARGETS,
) -> DataFrame:
    """Parameters and mean absolute error of each target, each group its own."""
    p1, p2 = nrtl_ln_gamma("a12", "t12", "t21", x, F.lit(1.0) - F.col(x), a21="a21")
    parameters = measured(parameters.select(*keys, *NRTL_PARAMETERS))
    scored = df.select(*keys, x, *targets).join(parameters, keys)
    errors = [F.avg(abs_error(nan_to_null(y), p)).alias(f"{y}_mae") for y, p in zip(targets, (p1, p2))]
    return parameters.join(scored.groupBy(*keys).agg(*errors), keys)


def polynomial_mae(df: DataFrame, fits: DataFrame, keys: list[str] = GROUP_KEYS, targets: list[str] = TARGETS, basis: str = "x") -> DataFrame:
    """Mean absolute error of each group's polynomial."""
    names = [c for c in coefficient_names() if c in fits.columns]
    predicted = eval_polynomial(df.join(measured(fits.select(*keys, *names)), keys), basis=basis, targets=targets)
    errors = [F.avg(abs_error(nan_to_null(t), f"{t}_pred")).alias(f"{t}_mae") for t in targets]
    return predicted.groupBy(*keys).agg(*errors)


def baseline_predictor(
    train: DataFrame, condition: str = "temperature_k", x: str = COMPOSITION, targets: list[str] = TARGETS
) -> DataFrame:
    """Straight line of each target on the composition, per condition."""
    lines = []
    for i, t in enumerate(targets, start=1):
        lines += [F.regr_slope(t, x).alias(f"slope_{i}"), F.regr_intercept(t, x).alias(f"intercept_{i}")]
    return train.groupBy(condition).agg(*lines)


def apply_predictor(
    df: DataFrame, model: DataFrame, condition: str = "temperature_k", x: str = COMPOSITION, targets: list[str] = TARGETS
) -> DataFrame:
    """Add ``{target}_pred``; conditions the model lacks give NULL."""
    joined = df.join(measured(model), condition, "left")
    preds = {
        f"{t}_pred": F.col(f"intercept_{i}") + F.col(f"slope_{i}") * F.col(x) for i, t in enumerate(targets, start=1)
    }
    return joined.withColumns(preds).drop(*[c for c in model.columns if c != condition])
