"""Two-liquid fits to convergence: bounded, damped Gauss-Newton over level statistics.

A group's levels lie in rows of at most ``LEVELS_PER_ROW`` levels.  Groups of one row are
solved where they lie, many at a time; for larger ones each step's normal equations are
summed over the rows, a round of the cluster per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.operators.fits import ALPHA_AXIS, NRTL_PARAMETERS, TAU_AXIS, grid_winners, nrtl_levels
from pairflow.schema import COMPOSITION, GROUP_KEYS, TARGETS
from pairflow.session import ensure_checkpoint_dir

LEVELS_PER_ROW = 4096
#: Problems of one row are solved together up to so many levels in all.
LEVELS_AT_ONCE = 200_000
STARTS, MAX_STEPS = 4, 60
#: A problem has ended when its slope, its step or what the step gained is below these, relative to the rest.
GRADIENT, STEP, GAIN, TINY = 1e-10, 1e-12, 1e-8, 1e-22
OPEN, CONVERGED, AT_BOUND, STUCK = range(4)
STATUS = ("not_converged", "converged", "at_bound", "not_converged")


def spread_matrix(single_alpha: bool) -> np.ndarray:
    """The four parameters from the free ones: free @ matrix."""
    return np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], dtype=float) if single_alpha else np.eye(4)


def bounds(spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.array([fixed.ALPHA_BOUNDS] * 2 + [fixed.TAU_BOUNDS] * 2)
    at = spread.argmax(axis=1)
    return all_[at, 0], all_[at, 1]


def model(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (problem, level, target) and their derivatives (.., parameter) at parameters ``p`` and compositions ``x``."""
    a12, a21, t12, t21 = (p[:, k, None] for k in range(4))
    y = 1.0 - x
    with np.errstate(all="ignore"):
        g12, g21 = np.exp(-a12 * t12), np.exp(-a21 * t21)
        d1, d2 = x + y * g21, y + x * g12
        u, v = g21 / d1, g12 / d2
        f = np.stack([y**2 * (t21 * u**2 + t12 * v / d2), x**2 * (t12 * v**2 + t21 * u / d1)], axis=2)
        by_g12 = np.stack([y**2 * t12 * (y - x * g12) / d2**3, x**2 * t12 * 2 * v * y / d2**2], axis=2) * g12[..., None]
        by_g21 = np.stack([y**2 * t21 * 2 * u * x / d1**2, x**2 * t21 * (x - y * g21) / d1**3], axis=2) * g21[..., None]
        by_t12 = np.stack([y**2 * v / d2, x**2 * v**2], axis=2)
        by_t21 = np.stack([y**2 * u**2, x**2 * u / d1], axis=2)
        j = np.stack(
            [-t12[..., None] * by_g12, -t21[..., None] * by_g21, by_t12 - a12[..., None] * by_g12, by_t21 - a21[..., None] * by_g21], axis=3
        )
    return np.nan_to_num(f, nan=0.0), np.nan_to_num(j, nan=0.0, posinf=0.0, neginf=0.0)


def normal_equations(q, x, n, mean, spread, objective):
    """Cost (without what no parameter changes), gradient and Gauss-Newton matrix of each problem.

    ``n`` and ``mean``: (problem, level, 3), for the two targets and their sum.
    """
    f, j = model(q @ spread, x)
    j = j @ spread.T
    if objective == "sum":
        f, j, n, mean = f.sum(axis=2)[..., None], j.sum(axis=2)[:, :, None], n[..., 2:], mean[..., 2:]
    else:
        n, mean = n[..., :2], mean[..., :2]
    with np.errstate(all="ignore"):
        miss = np.where(n > 0, f - mean, 0.0)
        cost = (n * miss**2).sum(axis=(1, 2))
        g = np.einsum("plt,plt,pltk->pk", n, miss, j)
        h = np.einsum("plt,pltk,pltm->pkm", n, j, j)
    bad = ~(np.isfinite(cost) & np.isfinite(g).all(axis=1) & np.isfinite(h).all(axis=(1, 2)))
    cost, g[bad], h[bad] = np.where(bad, np.inf, cost), 0.0, 0.0
    return cost, g, h


class Descent:
    """State of many problems: point, cost, gradient, matrix, damping and status."""

    def __init__(self, q, cost, g, h, damping=None, state=None):
        self.q, self.cost, self.g, self.h = q, cost, g, h
        self.damping = np.full(len(q), 1e-3) if damping is None else damping
        self.state = np.full(len(q), OPEN) if state is None else state

    def free(self, low, high):
        """Parameters that are not held at a bound by the gradient."""
        return ~(((self.q <= low) & (self.g > 0)) | ((self.q >= high) & (self.g < 0)))

    def trial(self, low, high):
        """The next point of each problem, within the bounds."""
        free = self.free(low, high)
        k = self.q.shape[1]
        h = self.h * (free[:, :, None] & free[:, None, :])
        size = np.einsum("pkk->pk", h)
        ridge = self.damping[:, None] * np.maximum(size, 1e-12 * size.max(axis=1, keepdims=True, initial=1e-300))
        h = h + (np.where(free, ridge, 1.0) + 1e-300)[:, :, None] * np.eye(k)
        scale = 1 / np.sqrt(np.maximum(np.einsum("pkk->pk", h), 1e-300))
        step = np.linalg.solve(h * scale[:, :, None] * scale[:, None, :] + 1e-14 * np.eye(k), -(self.g * free * scale)[..., None])[..., 0] * scale
        return np.clip(self.q + step, low, high)

    def advance(self, trial, cost, g, h, low, high):
        """Take the trial points that lower the cost, and see which problems have ended."""
        better = cost < self.cost
        step = trial - self.q
        moved = (np.abs(step) / (1e-8 + np.abs(self.q))).max(axis=1)
        promised = -2 * (self.g * step).sum(axis=1) - np.einsum("pk,pkm,pm->p", step, self.h, step)
        with np.errstate(all="ignore"):
            kept = np.clip(np.nan_to_num((self.cost - cost) / promised, nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
        gained = np.where(better, self.cost - cost, np.inf)
        pick = lambda new, old: np.where(better.reshape(-1, *[1] * (old.ndim - 1)), new, old)
        self.q, self.cost, self.g, self.h = pick(trial, self.q), pick(cost, self.cost), pick(g, self.g), pick(h, self.h)
        eased = np.maximum(0.1, 1 - (2 * kept - 1) ** 3)
        self.damping = np.clip(self.damping * np.where(better, eased, 4.0), 1e-15, 1e15)
        free = self.free(low, high)
        size = np.sqrt(np.maximum(np.einsum("pkk->pk", self.h), 1e-300))
        slope = (np.abs(self.g) / size * free).max(axis=1)
        flat = (slope <= GRADIENT * np.sqrt(np.maximum(self.cost, 1e-20))) | (self.cost <= TINY)
        flat |= (moved <= STEP) | (gained <= GAIN * self.cost)
        held = ((self.q <= low) | (self.q >= high)).any(axis=1)
        ended = np.where(flat, np.where(held, AT_BOUND, CONVERGED), np.where(self.damping >= 1e15, STUCK, OPEN))
        self.state = np.where(self.state == OPEN, ended, self.state)

    def part(self, at):
        return Descent(*(v[at] for v in (self.q, self.cost, self.g, self.h, self.damping, self.state)))

    def put(self, at, other):
        for name in ("q", "cost", "g", "h", "damping", "state"):
            getattr(self, name)[at] = getattr(other, name)


def descend(q, x, n, mean, spread, objective, steps: int = MAX_STEPS) -> Descent:
    """Solve many problems of equally many (padded) levels side by side."""
    low, high = bounds(spread)
    all_ = Descent(q, *normal_equations(q, x, n, mean, spread, objective))
    for _ in range(steps):
        at = np.flatnonzero(all_.state == OPEN)
        if not len(at):
            break
        some = all_.part(at)
        trial = some.trial(low, high)
        some.advance(trial, *normal_equations(trial, x[at], n[at], mean[at], spread, objective), low, high)
        all_.put(at, some)
    return all_


def padded(column, rows, width: int) -> np.ndarray:
    """Lists of a column side by side, filled up with 0."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = column[r].values.to_numpy(zero_copy_only=False)
        out[i, : len(v)] = v
    return out


def _solve(names, spread, objective, steps):
    low, high = bounds(spread)
    at = spread.argmax(axis=1)

    def run(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("x")])
            order = np.argsort(lengths, kind="stable")
            best = [None] * batch.num_rows
            first = 0
            while first < len(order):
                last = first + 1
                while last < len(order) and (last + 1 - first) * lengths[order[last]] * STARTS <= LEVELS_AT_ONCE:
                    last += 1
                rows = order[first:last]
                first, width = last, lengths[order[last - 1]]
                x = padded(batch.column("x"), rows, width)
                n = np.stack([padded(batch.column(f"n_{i}"), rows, width) for i in range(3)], axis=2)
                mean = np.stack([padded(batch.column(f"mean_{i}"), rows, width) for i in range(3)], axis=2)
                starts = [batch.column("starts")[int(r)].as_py() for r in rows]
                of = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
                q = np.clip(np.array([s for group in starts for s in group])[:, at], low, high)
                done = descend(q, x[of], n[of], mean[of], spread, objective, steps)
                points = done.q @ spread
                for k in np.lexsort((np.arange(len(of)), np.round(done.cost, 12))):
                    row = rows[of[k]]
                    if best[row] is None:
                        best[row] = (*points[k].tolist(), float(done.cost[k]), STATUS[done.state[k]])
            columns = [pa.array([b[k] for b in best], pa.string() if k == 5 else pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], [*names, *NRTL_PARAMETERS, "cost", "status"])

    return run


def _sums(names, spread, objective, k):
    """Normal equations of each row of levels at its group's trial point."""

    def run(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                width = len(batch.column("x")[r])
                x = padded(batch.column("x"), [r], width)
                n = np.stack([padded(batch.column(f"n_{i}"), [r], width) for i in range(3)], axis=2)
                mean = np.stack([padded(batch.column(f"mean_{i}"), [r], width) for i in range(3)], axis=2)
                q = np.array([batch.column("trial")[r].as_py()])
                cost, g, h = normal_equations(q, x, n, mean, spread, objective)
                out.append([float(cost[0]), *g[0].tolist(), *h[0].ravel().tolist()])
            columns = [pa.array([o[i] for o in out], pa.float64()) for i in range(1 + k + k * k)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], [*names, *[f"s{i}" for i in range(len(columns))]])

    return run


def _step(names, spread, k):
    """A step of each problem from the sums at its trial point."""
    low, high = bounds(spread)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            state = np.array(batch.column("state").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            trial = np.array(batch.column("trial").to_pylist())
            sums = np.stack([batch.column(f"s{i}").to_numpy() for i in range(1 + k + k * k)], axis=1)
            new = sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k :].reshape(-1, k, k)
            if state.shape[1] == 0:
                d = Descent(trial, *new)
            else:
                q, cost, g, h = state[:, :k], state[:, k], state[:, k + 1 : 2 * k + 1], state[:, 2 * k + 1 : -2].reshape(-1, k, k)
                d = Descent(q, cost, g, h, state[:, -2], state[:, -1].astype(int))
                d.advance(trial, *new, low, high)
            packed = np.concatenate([d.q, d.cost[:, None], d.g, d.h.reshape(-1, k * k), d.damping[:, None], d.state[:, None]], axis=1)
            columns = [pa.array(v.tolist(), pa.list_(pa.float64())) for v in (packed, d.trial(low, high))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], [*names, "state", "trial"])

    return run


def _in_rounds(blocks: DataFrame, starts: DataFrame, keys: list[str], kinds: str, spread, objective, steps: int) -> DataFrame:
    """Groups of several rows: each step sums the normal equations over the rows."""
    k = len(spread)
    low, high = bounds(spread)
    names = [*keys, "__start"]
    kinds = f"{kinds}, `__start` int"
    free = F.array(*[F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col("start")[int(i)])) for i, lo, hi in zip(spread.argmax(axis=1), low, high)])
    state = starts.select(*keys, F.posexplode("starts").alias("__start", "start")).select(
        *names, F.array().cast("array<double>").alias("state"), free.alias("trial")
    ).checkpoint()
    sums = ", ".join(f"s{i} double" for i in range(1 + k + k * k))
    done = None
    for _ in range(steps + 1):  # the first evaluates the starts
        each = blocks.join(state.select(*names, "trial"), keys).mapInArrow(_sums(names, spread, objective, k), f"{kinds}, {sums}")
        total = each.groupBy(*names).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(1 + k + k * k)])
        state = state.join(total, names).mapInArrow(_step(names, spread, k), f"{kinds}, state array<double>, trial array<double>").checkpoint()
        ended = state.filter(F.element_at("state", -1) != OPEN)
        done = ended if done is None else done.unionByName(ended)
        state = state.filter(F.element_at("state", -1) == OPEN)
        if state.isEmpty():
            break
    last = done.unionByName(state)
    q = [F.col("state")[i] for i in range(k)]
    parameters = [q[int(i)].alias(p) for i, p in zip(spread.argmax(axis=0), NRTL_PARAMETERS)]
    words = F.element_at(F.array(*map(F.lit, STATUS)), (F.element_at("state", -1) + 1).cast("int"))
    found = last.select(*keys, *parameters, F.col("state")[k].alias("cost"), words.alias("status"), "__start")
    best = F.min(F.struct(F.round("cost", 12).alias("r"), "__start", *NRTL_PARAMETERS, "cost", "status")).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, *[f"b.{c}" for c in (*NRTL_PARAMETERS, "cost", "status")])


def fit_nrtl(
    df: DataFrame,
    keys: list[str] = GROUP_KEYS,
    x: str = COMPOSITION,
    targets: list[str] = TARGETS,
    objective: str = "stacked",
    single_alpha: bool = False,
    alpha_axis: list[float] = ALPHA_AXIS,
    tau_axis: list[float] = TAU_AXIS,
    starts: int = STARTS,
    steps: int = MAX_STEPS,
    levels_per_row: int = LEVELS_PER_ROW,
) -> DataFrame:
    """Bounded least squares of the two-liquid parameters per group, to convergence.

    The best points of a grid, at most ``starts`` of them, are each taken downhill by damped
    Gauss-Newton steps that stay within the bounds; the lowest end counts.  ``status`` is
    "converged", "at_bound" (converged with a parameter on its bound), "not_converged" after
    ``steps``, or "too_few": fewer levels with values than parameters, which leaves
    parameters and objective NULL.  Two groups that differ in the order of rows only get the
    same fit.  Runs jobs when called.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spread = spread_matrix(single_alpha)
    levels = nrtl_levels(df, keys, x, targets).checkpoint()
    values = F.col("n_2") if objective == "sum" else F.col("n_0") + F.col("n_1")
    informed = (F.col("n_2") > 0).cast("int") if objective == "sum" else (F.col("n_0") > 0).cast("int") + (F.col("n_1") > 0).cast("int")
    inner = F.sum("ss_2") if objective == "sum" else F.sum("ss_0") + F.sum("ss_1")
    groups = levels.groupBy(*keys).agg(
        F.count("*").alias("n_levels"), F.sum(informed).alias("informed"), F.sum(values).alias("n_values"), inner.alias("inner")
    ).withColumn("rows", F.ceil(F.col("n_levels") / levels_per_row).cast("int")).checkpoint()
    grid = grid_winners(levels, keys, x, objective, single_alpha, alpha_axis, tau_axis, starts)
    winners = grid.checkpoint()
    fitted = groups.filter(F.col("informed") >= len(spread))
    cells = levels.join(fitted.select(*keys, "rows"), keys).withColumn("__row", F.pmod(F.xxhash64(x), F.col("rows")).cast("int"))
    packed = cells.groupBy(*keys, "rows", "__row").agg(
        F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), *[F.coalesce(f"{c}_{i}", F.lit(0)).cast("double").alias(f"{c}_{i}") for i in range(3) for c in ("n", "mean")]))).alias("l")
    )
    lists = [F.col(f"l.{c}").alias(c) for c in ("x", *[f"{c}_{i}" for i in range(3) for c in ("n", "mean")])]
    blocks = packed.select(*keys, "rows", *lists).checkpoint()
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keys)
    one = blocks.filter("rows = 1").drop("rows").join(winners, keys)
    schema = f"{kinds}, {', '.join(f'{p} double' for p in NRTL_PARAMETERS)}, cost double, status string"
    found = one.mapInArrow(_solve(keys, spread, objective, steps), schema)
    large = groups.filter((F.col("rows") > 1) & (F.col("informed") >= len(spread)))
    if not large.isEmpty():
        several = blocks.filter("rows > 1").drop("rows")
        found = found.unionByName(_in_rounds(several, winners.join(large.select(*keys), keys, "left_semi"), keys, kinds, spread, objective, steps))
    out = groups.select(*keys, "n_values", "inner").join(found, keys, "left")
    return out.select(
        *keys, *NRTL_PARAMETERS, (F.col("cost") + F.col("inner")).alias("objective"), "n_values", F.coalesce("status", F.lit("too_few")).alias("status")
    )
