"""Two-liquid fits: derivatives, known parameters, bounds, statuses, large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.operators import fits, nrtl

SCHEMA = "m1 string, m2 string, temperature_k double, x1 double, ln_gamma_1 double, ln_gamma_2 double"
AXES = dict(alpha_axis=[0.1, 0.4, 0.8], tau_axis=[-3.0, -1.0, 0.0, 1.0, 3.0, 10.0])


def curve(a12, a21, t12, t21, xs):
    f, _ = nrtl.model(np.array([[a12, a21, t12, t21]]), np.array([xs]))
    return [(float(x), float(a), float(b)) for x, (a, b) in zip(xs, f[0])]


def table(spark, groups):
    rows = [(k, "b", 300.0, *point) for k, points in groups.items() for point in points]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_name(df):
    return {r["m1"]: r for r in df.collect()}


def test_derivatives_are_those_of_the_model():
    rng = np.random.default_rng(0)
    p = np.column_stack([rng.uniform(0.05, 0.9, (20, 2)), rng.uniform(-3, 3, (20, 2))])
    x = np.tile(np.linspace(0.01, 0.99, 9), (20, 1))
    _, j = nrtl.model(p, x)
    for k in range(4):
        up, down = p.copy(), p.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        slope = (nrtl.model(up, x)[0] - nrtl.model(down, x)[0]) / 2e-6
        assert np.allclose(j[..., k], slope, rtol=1e-5, atol=1e-6)


def test_known_parameters_come_back(spark):
    xs = np.linspace(0, 1, 21)
    known = {"p": (0.3, 0.2, 1.2, 0.4), "q": (0.25, 0.35, 2.5, -0.7), "r": (0.45, 0.5, 0.8, 1.9)}
    got = by_name(nrtl.fit_nrtl(table(spark, {k: curve(*v, xs) for k, v in known.items()}), **AXES))
    for k, v in known.items():
        assert got[k]["status"] == "converged" and got[k]["n_values"] == 42
        assert got[k]["objective"] == pytest.approx(0.0, abs=1e-12)
        assert [got[k][n] for n in fits.NRTL_PARAMETERS] == pytest.approx(list(v), abs=1e-4)


def test_large_groups_take_the_same_steps(spark):
    rng = random.Random(4)
    groups = {f"g{k}": [(x / 10, rng.gauss(0, 1), rng.gauss(0, 1)) for x in range(11) for _ in range(2)] for k in range(3)}
    groups["small"] = groups["g0"][:8]
    df = table(spark, groups)
    whole, pieces = (by_name(nrtl.fit_nrtl(df, steps=4, levels_per_row=n, **AXES)) for n in (4096, 5))
    for k in groups:
        assert pieces[k]["objective"] == pytest.approx(whole[k]["objective"], rel=1e-6) and pieces[k]["status"] == whole[k]["status"]


@pytest.mark.parametrize("objective,single", [("stacked", False), ("stacked", True), ("sum", True)])
def test_never_above_the_grid_and_within_bounds(spark, objective, single):
    rng = random.Random(2)
    groups = {f"g{k}": [(x / 10, rng.gauss(0, 1), rng.gauss(0, 1)) for x in range(11) for _ in range(2)] for k in range(12)}
    groups["flat"] = [(x / 10, 0.0, 0.0) for x in range(11)]
    df = table(spark, groups)
    grid = by_name(fits.fit_nrtl_grid(df, objective=objective, single_alpha=single, refinements=0, **AXES))
    whole = by_name(nrtl.fit_nrtl(df, objective=objective, single_alpha=single, **AXES))
    assert whole.keys() == groups.keys()
    for k, r in whole.items():
        assert r["objective"] <= grid[k]["objective"] + 1e-9
        assert all(1e-4 <= r[a] <= 1 for a in ("a12", "a21")) and all(abs(r[t]) <= 366 for t in ("t12", "t21"))
        assert r["status"] != "too_few" and (not single or r["a12"] == r["a21"])
    assert whole["flat"]["objective"] == pytest.approx(0.0, abs=1e-12)


def test_ends_where_the_gradient_does(spark):
    """No small move within the bounds lowers the objective."""
    rng = random.Random(5)
    points = [(x, a + rng.gauss(0, 0.05), b + rng.gauss(0, 0.05)) for x, a, b in curve(0.3, 0.2, 1.5, 0.5, np.linspace(0, 1, 11))]
    r = by_name(nrtl.fit_nrtl(table(spark, {"g": points}), steps=1000, **AXES))["g"]
    assert r["status"] in ("converged", "at_bound")
    x, y = np.array([[p[0] for p in points]]), np.array([[p[1:] for p in points]])
    at = np.array([[r[n] for n in fits.NRTL_PARAMETERS]])
    cost = lambda p: ((nrtl.model(p, x)[0] - y) ** 2).sum()
    assert cost(at) == pytest.approx(r["objective"], rel=1e-9)
    for k in range(4):
        for step in (-1e-3, 1e-3):
            moved = at.copy()
            moved[0, k] += step
            if np.all(np.abs(moved) <= (1, 1, 366, 366)) and np.all(moved[0, :2] >= 1e-4):
                assert cost(moved) > cost(at) * (1 - 1e-6)


def test_too_few_levels_and_missing_values(spark):
    points = curve(0.3, 0.3, 1.0, 0.5, np.linspace(0, 1, 11))
    groups = {"one": points[:1] * 9, "null": [(x, None, None) for x, _, _ in points], "half": [(x, a, None) for x, a, _ in points], "ok": points}
    got = by_name(nrtl.fit_nrtl(table(spark, groups).withColumn("n_levels", F.lit("clash")), **AXES))
    for k in ("one", "null"):
        assert got[k]["status"] == "too_few" and got[k]["objective"] is None and got[k]["a12"] is None
    assert got["half"]["status"] in ("converged", "at_bound") and got["half"]["objective"] == pytest.approx(0.0, abs=1e-9)
    assert nrtl.fit_nrtl(spark.createDataFrame([], SCHEMA)).collect() == []
