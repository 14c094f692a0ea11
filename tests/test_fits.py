"""Grouped fits against numpy and known parameters."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairflow.functions.models import nrtl_ln_gamma
from pairflow.operators import fits as i
from pairflow.operators.groups import apply_per_group, group_failures
from pairflow.plans.jobs import external_scores_job, fit_job
from pairflow.schema import GROUP_KEYS, coefficient_names

SCHEMA = "row_id string, m1 string, m2 string, temperature_k double, x1 double, ln_gamma_1 double, ln_gamma_2 double"


def frame(spark, groups):
    data = []
    for (m1, m2, t), points in groups.items():
        for k, (x, y1, y2) in enumerate(points):
            data.append((f"{m1}{m2}{t}{k}", m1, m2, t, x, y1, y2))
    return spark.createDataFrame(data, SCHEMA)


def by_key(df):
    return {(r["m1"], r["m2"]): r.asDict() for r in df.collect()}


QUARTIC = [1.0, -2.0, 3.0, -4.0, 5.0]


def quartic(x):
    return sum(c * x**j for j, c in enumerate(QUARTIC))


def test_exact_quartic_and_failures(spark):
    xs = [0.0, 0.13, 0.31, 0.52, 0.77, 1.0]
    groups = {
        ("a", "b", 300.0): [(x, quartic(x), -quartic(x)) for x in xs],
        ("a", "c", 300.0): [(x, 1.0, 1.0) for x in xs[:4]],
        ("a", "d", 300.0): [(x, 1.0, 1.0) for x in (0.1, 0.1, 0.2, 0.2, 0.3)],
        ("a", "e", 300.0): [(x, 1.0, 1.0) for x in xs[:3]],
        ("a", "f", 300.0): [(x, None if k < 2 else quartic(x), quartic(x)) for k, x in enumerate(xs)],
    }
    got = by_key(i.fit_polynomial(frame(spark, groups)))
    assert ("a", "e") not in got
    assert [got["a", "b"][f"c{j}_0"] for j in range(5)] == pytest.approx(QUARTIC, abs=1e-8)
    assert [got["a", "b"][f"c{j}_1"] for j in range(5)] == pytest.approx([-c for c in QUARTIC], abs=1e-8)
    assert got["a", "c"]["status_0"] == "too_few" and got["a", "c"]["c0_0"] is None
    assert got["a", "d"]["status_0"] == "rank_deficient" and got["a", "d"]["c0_0"] is None
    # A failed first target leaves the second one in its place.
    assert got["a", "f"]["status_0"] == "too_few" and got["a", "f"]["status_1"] == "ok"
    assert got["a", "f"]["c1_1"] == pytest.approx(-2.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_fit_and_statistics_equal_least_squares(spark, parts):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 1, 60), 2)
    y1, y2 = np.sin(3 * x) + 0.1 * rng.normal(size=60), rng.normal(size=60)
    df = frame(spark, {("a", "b", 300.0): [tuple(map(float, p)) for p in zip(x, y1, y2)]}).repartition(parts)
    r = fit_job(df).first().asDict()
    for k, y in enumerate((y1, y2)):
        want = np.polynomial.polynomial.polyfit(x, y, 4)
        assert [r[f"c{j}_{k}"] for j in range(5)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-7)
        chi = float(((y - np.polynomial.polynomial.polyval(x, want)) ** 2).sum())
        assert r[f"chisqr_{k}"] == pytest.approx(chi, rel=1e-8)
        assert r[f"aic_{k}"] == pytest.approx(60 * math.log(chi / 60) + 10, rel=1e-8)
        assert r[f"bic_{k}"] == pytest.approx(60 * math.log(chi / 60) + 5 * math.log(60), rel=1e-8)


def test_rows_are_combined_before_they_are_shuffled(spark, plan):
    df = frame(spark, {("a", "b", 300.0): [(0.1, 1.0, 1.0)]})
    text = plan(i.fit_polynomial(df))
    assert "partial_avg" in text and "FlatMapGroups" not in text


def test_widen_is_the_inverse_of_lengthen(spark):
    xs = [0.0, 0.1, 0.3, 0.5, 0.7, 1.0]
    fits = i.fit_polynomial(frame(spark, {("a", "b", 300.0): [(x, quartic(x), 2.0) for x in xs]}))
    wide = i.widen_coefficients(i.lengthen_coefficients(fits), GROUP_KEYS, "target", "coefficients")
    names = coefficient_names()
    assert wide.select(names).first() == fits.select(names).first()


def test_basis_of_the_second_target(spark):
    df = spark.createDataFrame([(0.2, *QUARTIC, *QUARTIC)], "x1 double, " + ", ".join(f"{c} double" for c in coefficient_names()))
    same, other = (i.eval_polynomial(df, basis=b).first() for b in ("x", "one_minus_x"))
    assert same["ln_gamma_2_pred"] == pytest.approx(quartic(0.2))
    assert other["ln_gamma_1_pred"] == pytest.approx(quartic(0.2))
    assert other["ln_gamma_2_pred"] == pytest.approx(quartic(0.8))
    with pytest.raises(ValueError):
        i.eval_polynomial(df, basis="y")


def test_split_tables_by_key_and_by_row(spark):
    xs = [0.0, 0.1, 0.3, 0.5, 0.7, 1.0]
    df = frame(spark, {("a", "b", 300.0): [(x, quartic(x), 2.0) for x in xs], ("a", "c", 300.0): [(0.1, 1.0, 1.0)]})
    fits = i.fit_polynomial(df)
    splits = df.withColumn("split", F.when(F.col("x1") < 0.4, "train").otherwise("test_indp"))
    assert i.polynomial_split_tables(fits, splits).count() == 2
    assert i.polynomial_split_tables(fits, splits, dedupe="row").count() == 6
    with pytest.raises(ValueError):
        i.polynomial_split_tables(fits, splits, dedupe="all")


def known_nrtl(spark, a12, a21, t12, t21):
    x = spark.range(11).select((F.col("id") / 10).alias("x1"))
    one, two = nrtl_ln_gamma(F.lit(a12), F.lit(t12), F.lit(t21), "x1", 1 - F.col("x1"), a21=F.lit(a21))
    points = [(r["x1"], r[1], r[2]) for r in x.select("x1", one, two).collect()]
    return frame(spark, {("a", "b", 300.0): points, ("a", "c", 300.0): [(x, 0.0, 0.0) for x, _, _ in points]})


def test_nrtl_finds_parameters_on_the_grid(spark):
    df = known_nrtl(spark, 0.3, 0.3, 1.0, 0.5)
    got = by_key(i.fit_nrtl_grid(df, single_alpha=True, alpha_axis=[0.2, 0.3], tau_axis=[0.0, 0.5, 1.0], refinements=0))
    r = got["a", "b"]
    assert (r["a12"], r["a21"], r["t12"], r["t21"]) == (0.3, 0.3, 1.0, 0.5)
    assert r["objective"] == pytest.approx(0.0, abs=1e-12)
    # All of alpha ties when both tau are zero: the first grid point wins.
    assert (got["a", "c"]["t12"], got["a", "c"]["t21"], got["a", "c"]["a12"]) == (0.0, 0.0, 0.2)
    errors = by_key(i.evaluate_nrtl(df, i.fit_nrtl_grid(df, alpha_axis=[0.3], tau_axis=[0.0, 0.5, 1.0], refinements=0)))
    assert errors["a", "b"]["ln_gamma_1_mae"] == pytest.approx(0.0, abs=1e-12)
    assert errors["a", "c"]["ln_gamma_2_mae"] == pytest.approx(0.0, abs=1e-12)


def test_nrtl_refinement_improves_and_stays_in_bounds(spark):
    df = known_nrtl(spark, 0.25, 0.35, 1.2, 0.4)
    cost = [by_key(i.fit_nrtl_grid(df, refinements=k))["a", "b"] for k in (0, 1, 3)]
    assert cost[0]["objective"] >= cost[1]["objective"] >= cost[2]["objective"]
    assert all(1e-4 <= c[a] <= 1 for c in cost for a in ("a12", "a21"))


def test_summed_objective_lets_errors_cancel(spark):
    df = frame(spark, {("a", "b", 300.0): [(x / 10, 1.0, -1.0) for x in range(11)]})
    axes = dict(alpha_axis=[0.2], tau_axis=[0.0], refinements=0)
    assert by_key(i.fit_nrtl_grid(df, objective="sum", **axes))["a", "b"]["objective"] == pytest.approx(0.0)
    assert by_key(i.fit_nrtl_grid(df, objective="stacked", **axes))["a", "b"]["objective"] == pytest.approx(22.0)
    with pytest.raises(ValueError):
        i.fit_nrtl_grid(df, objective="max")


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_apply_per_group_in_any_parts(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _check_apply_per_group(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_longer_result_fails_the_group(spark):
    df = frame(spark, {("a", "b", 1.0): [(x / 40, 0.0, 0.0) for x in range(40)]})
    out = apply_per_group(df, GROUP_KEYS, lambda key, rows: pd.DataFrame({"p": [0.0] * (len(rows) + 1)}), ["p"])
    assert {(r["status"], r["p"]) for r in out.collect()} == {("incomplete", None)}


def _check_apply_per_group(spark):
    def predictor(key, rows):
        m1, m2, temperature = key
        if m2 == "bad":
            raise KeyError(m2)
        out = pd.DataFrame({"p": rows["x1"] * temperature})
        return out.iloc[:-1] if m2 == "short" else out

    points = [(x / 40, float(x), 0.0) for x in range(40)]
    groups = {("a", m2, t): points for m2, t in (("ok", 2.0), ("bad", 2.0), ("short", 2.0), ("ok", 3.0))}
    df = frame(spark, groups)
    out = apply_per_group(df, GROUP_KEYS, predictor, ["p"])
    assert out.count() == df.count()
    assert out.filter("m2 = 'ok'").filter(F.abs(F.col("p") - F.col("x1") * F.col("temperature_k")) < 1e-12).count() == 80
    assert out.filter("m2 <> 'ok' AND p IS NOT NULL").count() == 0
    report = {r["m2"]: (r["status"], r["n_rows"]) for r in group_failures(out).collect()}
    assert report == {"bad": ("error", 40), "short": ("incomplete", 40)}


def test_one_short_part_fails_the_whole_group(spark):
    def picky(key, rows):
        out = pd.DataFrame({"p": rows["x1"]})
        return out[rows["x1"] < 0.9]

    df = frame(spark, {("a", "b", 1.0): [(x / 40, 0.0, 0.0) for x in range(40)]})
    out = apply_per_group(df, GROUP_KEYS, picky, ["p"])
    assert {(r["status"], r["p"]) for r in out.collect()} == {("incomplete", None)}


def test_external_scores(spark):
    def half(key, rows):
        return pd.DataFrame({"ln_gamma_1_pred": rows["ln_gamma_1"], "ln_gamma_2_pred": rows["ln_gamma_2"] + 1})

    df = frame(spark, {("a", "b", 1.0): [(x / 10, float(x), float(x)) for x in range(11)]})
    r = external_scores_job(df, half).first()
    assert r["ln_gamma_1_rmse"] == 0.0 and r["ln_gamma_1_r2"] == 1.0
    assert r["ln_gamma_2_mae"] == 1.0 and r["ln_gamma_2_r2"] == pytest.approx(0.9)


def test_the_alpha_axis_reaches_its_whole_range():
    gaps = i._half_gap(i.ALPHA_AXIS, (0.0, 1.0))
    reach = sorted((a - g, a + g) for a, g in zip(i.ALPHA_AXIS, gaps))
    assert reach[0][0] <= 0.0 and reach[-1][1] >= 1.0 - 1e-9
    assert all(b[0] <= a[1] + 0.05 for a, b in zip(reach, reach[1:]))
