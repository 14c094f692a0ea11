"""Grouped fits (I1-I9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairflow.catalog.io_queries import SPLIT_STEPS
from pairflow.catalog.registry import query, round_columns, rounded
from pairflow.catalog.views import OBS, ROLES, obs, roles
from pairflow.operators import fits as i
from pairflow.operators.groups import apply_per_group
from pairflow.operators.nrtl import fit_nrtl
from pairflow.operators.reports import compare_fits
from pairflow.operators.sizing import measured
from pairflow.operators.splits import assign_pair_splits
from pairflow.plans.jobs import fit_job
from pairflow.schema import GROUP_KEYS, coefficient_names

# Least squares by orthogonal polynomials on the integers 10 x - 5, then expanded.
def _gram_schmidt(target: str, label: str) -> str:
    """CTEs that fit a quartic of one target by Gram-Schmidt over each group's rows."""
    g = "PARTITION BY m1, m2, temperature_k"
    ctes = [f"{label}0 AS (SELECT *, 10 * x1 - 5 AS u, 1.0::DOUBLE AS q0 FROM big)"]
    for k in range(1, 5):
        # q_k = u * q_{k-1} - sum_j <u q_{k-1}, q_j> / <q_j, q_j> q_j ; only j = k-1, k-2 contribute.
        terms = "".join(
            f" - q{j} * (sum(u * q{k-1} * q{j}) OVER ({g})) / nullif(sum(q{j} * q{j}) OVER ({g}), 0)" for j in range(max(0, k - 2), k)
        )
        ctes.append(f"{label}{k} AS (SELECT *, u * q{k-1}{terms} AS q{k} FROM {label}{k-1})")
    proj = ", ".join(f"sum(q{k} * {target}) / nullif(sum(q{k} * q{k}), 0) AS d{k}" for k in range(5))
    ctes.append(f"{label}d AS (SELECT m1, m2, temperature_k, {proj} FROM {label}4 GROUP BY 1, 2, 3)")
    fitted = " + ".join(f"d{k} * q{k}" for k in range(5))
    ctes.append(f"{label}f AS (SELECT a.*, {fitted} AS fitted FROM {label}4 a JOIN {label}d USING (m1, m2, temperature_k))")
    return ",\n".join(ctes)


GROUPS = """big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY m1, m2, temperature_k) AS n FROM obs) WHERE n >= 4),
status AS (SELECT m1, m2, temperature_k, count(*) AS n_rows,
  CASE WHEN count(*) < 5 THEN 'too_few' WHEN count(DISTINCT x1) < 5 THEN 'rank_deficient' ELSE 'ok' END AS status
  FROM big GROUP BY 1, 2, 3)"""


def _elimination(target: str, label: str) -> str:
    """CTEs that solve the 5 x 5 normal equations in u and expand to powers of x."""
    sums = [f"sum(pow(10 * x1 - 5, {k})) AS s{k}" for k in range(9)] + [f"sum(pow(10 * x1 - 5, {k}) * {target}) AS t{k}" for k in range(5)]
    ctes = [f"{label}s AS (SELECT m1, m2, temperature_k, {', '.join(sums)} FROM big GROUP BY 1, 2, 3)"]
    first = [f"s{r + c} AS a{r}{c}" for r in range(5) for c in range(5)] + [f"t{r} AS a{r}5" for r in range(5)]
    ctes.append(f"{label}0 AS (SELECT m1, m2, temperature_k, {', '.join(first)} FROM {label}s JOIN status USING (m1, m2, temperature_k) WHERE status = 'ok')")
    for k in range(5):  # Gauss-Jordan: clear column k from every other row
        cells = []
        for r in range(5):
            for c in range(6):
                cells.append(f"a{k}{c} / a{k}{k} AS a{k}{c}" if r == k else f"a{r}{c} - a{r}{k} / a{k}{k} * a{k}{c} AS a{r}{c}")
        ctes.append(f"{label}{k + 1} AS (SELECT m1, m2, temperature_k, {', '.join(cells)} FROM {label}{k})")
    b0, b1, b2, b3, b4 = (f"a{r}5" for r in range(5))
    powers = [
        f"{b0} - 5 * {b1} + 25 * {b2} - 125 * {b3} + 625 * {b4} AS c0",
        f"10 * ({b1} - 10 * {b2} + 75 * {b3} - 500 * {b4}) AS c1",
        f"100 * ({b2} - 15 * {b3} + 150 * {b4}) AS c2",
        f"1000 * ({b3} - 20 * {b4}) AS c3",
        f"10000 * {b4} AS c4",
    ]
    ctes.append(f"{label} AS (SELECT m1, m2, temperature_k, {', '.join(powers)} FROM {label}5)")
    return ",\n".join(ctes)


FITTED = f"{OBS}, {GROUPS}, {_elimination('ln_gamma_1', 'fa')}, {_elimination('ln_gamma_2', 'fb')}"
COEFFICIENTS = ", ".join(f"{f}.c{j} AS c{j}_{k}" for k, f in enumerate(("fa", "fb")) for j in range(5))
ROUNDED = ", ".join(f"round({f}.c{j}, 2) + 0.0 AS c{j}_{k}" for k, f in enumerate(("fa", "fb")) for j in range(5))
CURVES = f"""curves AS (SELECT m1, m2, temperature_k, {COEFFICIENTS} FROM fa JOIN fb USING (m1, m2, temperature_k)),
curve_values AS (SELECT b.*,
  c0_0 + c1_0 * x1 + c2_0 * x1 ** 2 + c3_0 * x1 ** 3 + c4_0 * x1 ** 4 AS p1,
  c0_1 + c1_1 * x1 + c2_1 * x1 ** 2 + c3_1 * x1 ** 3 + c4_1 * x1 ** 4 AS p2
  FROM big b JOIN curves USING (m1, m2, temperature_k))"""
STATISTICS = f"""{CURVES},
chi AS (SELECT m1, m2, temperature_k, count(*) AS n, sum(pow(ln_gamma_1 - p1, 2)) AS x0, sum(pow(ln_gamma_2 - p2, 2)) AS x1
        FROM curve_values GROUP BY 1, 2, 3)"""


@query("i1_fit_polynomial", f"""
WITH {FITTED}
SELECT m1, m2, temperature_k, n_rows, status AS status_0, status AS status_1, {ROUNDED}
FROM status LEFT JOIN fa USING (m1, m2, temperature_k) LEFT JOIN fb USING (m1, m2, temperature_k)""")
def _(t):
    out = i.fit_polynomial(obs(t)).select(*GROUP_KEYS, "n_rows", "status_0", "status_1", *coefficient_names())
    return round_columns(out, coefficient_names(), 2)


@query("i1_fitted_values", f"""
WITH {OBS}, {GROUPS}, {_gram_schmidt('ln_gamma_1', 'g')}
SELECT row_id, round(fitted, 5) + 0.0 AS fitted FROM gf JOIN status USING (m1, m2, temperature_k) WHERE status = 'ok'""")
def _(t):
    o = obs(t)
    fits = i.fit_polynomial(o).filter("status_0 = 'ok'")
    values = i.eval_polynomial(o.join(measured(fits), GROUP_KEYS))
    return values.select("row_id", rounded("ln_gamma_1_pred", 5).alias("fitted"))


def _figures(k: int) -> str:
    """Rounded figures of a target; NULL where the residual is too small for them to be the same in two engines."""
    known = f"CASE WHEN x{k} > 1e-3 THEN {{}} END"
    return ", ".join([
        known.format(f"round(x{k}, 5)") + f" AS chisqr_{k}",
        known.format(f"round(n * ln(x{k} / n) + 10, 4)") + f" AS aic_{k}",
        known.format(f"round(n * ln(x{k} / n) + 5 * ln(n), 4)") + f" AS bic_{k}",
    ])


@query("i2_fit_statistics", f"""
WITH {FITTED}, {STATISTICS}
SELECT m1, m2, temperature_k, {_figures(0)}, {_figures(1)} FROM status LEFT JOIN chi USING (m1, m2, temperature_k)""")
def _(t):
    out = fit_job(obs(t))
    places = {"chisqr": 5, "aic": 4, "bic": 4}
    stable = [
        F.when(F.col(f"chisqr_{k}") > 1e-3, rounded(f"{s}_{k}", n)).alias(f"{s}_{k}") for k in (0, 1) for s, n in places.items()
    ]
    return out.select(*GROUP_KEYS, *stable)


@query("i3_widen_coefficients", f"""
WITH {FITTED}
SELECT m1, m2, temperature_k, {ROUNDED} FROM status LEFT JOIN fa USING (m1, m2, temperature_k) LEFT JOIN fb USING (m1, m2, temperature_k)""")
def _(t):
    rows = i.lengthen_coefficients(i.fit_polynomial(obs(t)))
    return round_columns(i.widen_coefficients(rows, GROUP_KEYS, "target", "coefficients"), coefficient_names(), 2)


SPLIT_KEYS = f"{SPLIT_STEPS}, labels_of AS (SELECT * FROM s)"


def _splits(t):
    return assign_pair_splits(obs(t), roles(t), "id")


@query("i4_polynomial_split_tables", f"""
WITH {FITTED}, {ROLES}, {SPLIT_KEYS}
SELECT DISTINCT split, m1, m2, temperature_k, {ROUNDED} FROM labels_of JOIN status USING (m1, m2, temperature_k)
LEFT JOIN fa USING (m1, m2, temperature_k) LEFT JOIN fb USING (m1, m2, temperature_k) WHERE split IS NOT NULL""")
def _(t):
    return round_columns(i.polynomial_split_tables(i.fit_polynomial(obs(t)), _splits(t)), coefficient_names(), 2)


@query("i4_polynomial_split_tables_compat", f"""
WITH {FITTED}, {ROLES}, {SPLIT_KEYS},
d AS (SELECT DISTINCT split, m1, m2, temperature_k, x1, ln_gamma_1, ln_gamma_2 FROM labels_of WHERE split IS NOT NULL)
SELECT split, m1, m2, temperature_k, {ROUNDED} FROM d JOIN status USING (m1, m2, temperature_k)
LEFT JOIN fa USING (m1, m2, temperature_k) LEFT JOIN fb USING (m1, m2, temperature_k)""")
def _(t):
    splits = _splits(t).drop("row_id")
    return round_columns(i.polynomial_split_tables(i.fit_polynomial(obs(t)), splits, dedupe="row"), coefficient_names(), 2)


# One shared alpha; the same axes, steps and bounds as the operator's defaults.
def _nrtl_sql(objective: str, alpha: list[float], tau: list[float], result: str = "min(round(cost, 6)) + 0.0 AS objective") -> str:
    f1 = "pow(x2, 2) * (t21 * pow(g21 / nullif(x1 + x2 * g21, 0), 2) + t12 * g12 / nullif(pow(x2 + x1 * g12, 2), 0))"
    f2 = "pow(x1, 2) * (t12 * pow(g12 / nullif(x2 + x1 * g12, 0), 2) + t21 * g21 / nullif(pow(x1 + x2 * g21, 2), 0))"
    big = 1.7976931348623157e308
    clean = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0 WHEN {0} = 'inf'::DOUBLE THEN {1} WHEN {0} = '-inf'::DOUBLE THEN -{1} ELSE {0} END"
    cost = {
        "stacked": "n * (pow(m1, 2) - 2 * m1 * y1 + pow(m2, 2) - 2 * m2 * y2) + q1 + q2",
        "sum": "n * pow(m1 + m2, 2) - 2 * n * (m1 + m2) * (y1 + y2) + q3",
    }[objective]
    return f"""
WITH {OBS},
lv AS (SELECT m1 AS e1, m2 AS e2, temperature_k, x1, 1 - x1 AS x2, count(*) AS n, avg(ln_gamma_1) AS y1, avg(ln_gamma_2) AS y2,
  sum(pow(ln_gamma_1, 2)) AS q1, sum(pow(ln_gamma_2, 2)) AS q2, sum(pow(ln_gamma_1 + ln_gamma_2, 2)) AS q3 FROM obs GROUP BY ALL),
axes AS (SELECT a, t12, t21, row_number() OVER (ORDER BY a, t12, t21) AS k
  FROM (SELECT unnest({alpha}::DOUBLE[]) AS a), (SELECT unnest({tau}::DOUBLE[]) AS t12), (SELECT unnest({tau}::DOUBLE[]) AS t21)),
xs AS (SELECT DISTINCT x1, x2 FROM lv),
g AS (SELECT *, exp(-a * t12) AS g12, exp(-a * t21) AS g21 FROM axes, xs),
raw AS (SELECT k, a, t12, t21, x1, {f1} AS r1, {f2} AS r2 FROM g),
model AS (SELECT k, a, t12, t21, x1, {clean.format('r1', big)} AS m1, {clean.format('r2', big)} AS m2 FROM raw),
total AS (SELECT e1, e2, temperature_k, k, a, t12, t21, sum({cost}) AS cost FROM lv JOIN model USING (x1) GROUP BY ALL)
SELECT e1 AS m1, e2 AS m2, temperature_k, {result} FROM total GROUP BY e1, e2, temperature_k"""


_ALPHA, _TAU = [0.2, 0.4], [-3.0, -1.0, -0.3, 0.0, 0.3, 1.0, 3.0]


def _grid_fits(t, objective):
    return i.fit_nrtl_grid(obs(t), objective=objective, single_alpha=True, alpha_axis=_ALPHA, tau_axis=_TAU, refinements=0)


def _nrtl(t, objective):
    return round_columns(_grid_fits(t, objective).select(*GROUP_KEYS, "objective"), ["objective"], 6)


@query("i5_fit_nrtl_grid", _nrtl_sql("stacked", _ALPHA, _TAU))
def _(t):
    return _nrtl(t, "stacked")


@query("i5_fit_nrtl_grid_compat", _nrtl_sql("sum", _ALPHA, _TAU))
def _(t):
    return _nrtl(t, "sum")


@query("i5_fit_nrtl_refined")
def _(t):
    """Four free parameters, from the grid's winners to convergence, with their status."""
    return fit_nrtl(obs(t), tau_axis=[-10.0, -3.0, -1.0, 0.0, 1.0, 3.0, 10.0])


@query("i5_fit_nrtl_grid_parameters", _nrtl_sql("stacked", _ALPHA, _TAU, "min_by({'a': a, 't12': t12, 't21': t21}, (round(cost, 9), k)) AS p").replace(
    "SELECT e1 AS m1", "SELECT m1, m2, temperature_k, p.a AS a12, p.a AS a21, p.t12 AS t12, p.t21 AS t21 FROM (SELECT e1 AS m1") + ")")
def _(t):
    return _grid_fits(t, "stacked").select(*GROUP_KEYS, *i.NRTL_PARAMETERS)


@query("i6_evaluate_nrtl", f"""
WITH {OBS}, g AS (SELECT *, 1 - x1 AS x2, (m1 - 12) / 10.0 AS t12, (m2 - 12) / 10.0 AS t21,
   exp(-0.2 * (m1 - 12) / 10.0) AS g12, exp(-0.4 * (m2 - 12) / 10.0) AS g21 FROM obs)
SELECT m1, m2, temperature_k, 0.2::DOUBLE AS a12, 0.4::DOUBLE AS a21, t12::DOUBLE AS t12, t21::DOUBLE AS t21,
  round(avg(abs(ln_gamma_1 - pow(x2, 2) * (t21 * pow(g21 / (x1 + x2 * g21), 2) + t12 * g12 / pow(x2 + x1 * g12, 2)))), 6) AS ln_gamma_1_mae,
  round(avg(abs(ln_gamma_2 - pow(x1, 2) * (t12 * pow(g12 / (x2 + x1 * g12), 2) + t21 * g21 / pow(x1 + x2 * g21, 2)))), 6) AS ln_gamma_2_mae
FROM g GROUP BY m1, m2, temperature_k, t12, t21""")
def _(t):
    o = obs(t)
    parameters = o.select(*GROUP_KEYS).distinct().withColumns(
        {"a12": F.lit(0.2), "a21": F.lit(0.4), "t12": (F.col("m1") - 12) / F.lit(10.0), "t21": (F.col("m2") - 12) / F.lit(10.0)}
    )
    return round_columns(i.evaluate_nrtl(o, parameters), ["ln_gamma_1_mae", "ln_gamma_2_mae"])


_F1 = "pow(1 - x1, 2) * (t21 * pow(g21 / (x1 + (1 - x1) * g21), 2) + t12 * g12 / pow((1 - x1) + x1 * g12, 2))"
_FITTED_NRTL = _nrtl_sql("stacked", _ALPHA, _TAU, "min_by({'a': a, 't12': t12, 't21': t21}, (round(cost, 9), k)) AS p")


@query("i7_compare_fits", f"""
WITH {FITTED}, {CURVES},
nrtl AS ({_FITTED_NRTL}),
poly AS (SELECT avg(abs(ln_gamma_1 - p1)) AS mae FROM curve_values GROUP BY m1, m2, temperature_k),
factors AS (SELECT m1, m2, temperature_k, p.t12 AS t12, p.t21 AS t21, exp(-p.a * p.t12) AS g12, exp(-p.a * p.t21) AS g21 FROM nrtl),
two AS (SELECT avg(abs(ln_gamma_1 - {_F1})) AS mae FROM obs JOIN factors USING (m1, m2, temperature_k) GROUP BY m1, m2, temperature_k)
SELECT model, CAST(floor(mae / 0.1) AS INTEGER) AS bin, count(*) AS n FROM (
  SELECT 'Polynomial' AS model, mae FROM poly UNION ALL SELECT 'NRTL', mae FROM two) WHERE mae < 0.5 GROUP BY 1, 2""")
def _(t):
    """Error distributions of the quartic and of the two-liquid model, each with its own fit of every group."""
    o = obs(t)
    fits = i.fit_polynomial(o).filter("status_0 = 'ok' AND status_1 = 'ok'")
    edges = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
    out = compare_fits(i.polynomial_mae(o, fits), i.evaluate_nrtl(o, _grid_fits(t, "stacked")), "ln_gamma_1_mae", 0.5, edges=edges)
    return out.filter("n > 0").select("model", "bin", "n")


def outside_predictor():
    """A stand-in for an outside predictor, which fails for some pairs."""

    def predict(key, rows: pd.DataFrame) -> pd.DataFrame:
        m1, m2, temperature = key
        if m1 == m2:
            raise ValueError("identical entities")
        a = 0.05 * (m1 - m2) + 0.001 * (temperature - 1990.0)
        out = pd.DataFrame({"ln_gamma_1_pred": a * (1 - rows["x1"]) ** 2, "ln_gamma_2_pred": a * rows["x1"] ** 2})
        return out.iloc[:-1] if m1 % 7 == 3 else out

    return predict


@query("i8_apply_per_group", f"""
WITH {OBS}, p AS (SELECT *, 0.05 * (m1 - m2) + 0.001 * (temperature_k - 1990) AS a,
  CASE WHEN m1 = m2 THEN 'error' WHEN m1 % 7 = 3 THEN 'incomplete' ELSE 'ok' END AS status FROM obs)
SELECT row_id, status, CASE WHEN status = 'ok' THEN round(a * pow(1 - x1, 2), 6) + 0.0 END AS ln_gamma_1_pred,
       CASE WHEN status = 'ok' THEN round(a * pow(x1, 2), 6) + 0.0 END AS ln_gamma_2_pred FROM p""")
def _(t):
    names = ["ln_gamma_1_pred", "ln_gamma_2_pred"]
    out = apply_per_group(obs(t).select("row_id", *GROUP_KEYS, "x1"), GROUP_KEYS, outside_predictor(), names)
    return round_columns(out.select("row_id", "status", *names), names)


@query("i9_baseline_predictor", f"""
WITH {OBS}, m AS (SELECT temperature_k, covar_pop(ln_gamma_1, x1) / var_pop(x1) AS s1, avg(x1) AS xm, avg(ln_gamma_1) AS ym,
  covar_pop(ln_gamma_2, x1) / var_pop(x1) AS s2, avg(ln_gamma_2) AS zm FROM obs WHERE m1 < 15 GROUP BY 1)
SELECT row_id, round(ym + s1 * (x1 - xm), 6) + 0.0 AS ln_gamma_1_pred, round(zm + s2 * (x1 - xm), 6) + 0.0 AS ln_gamma_2_pred
FROM obs JOIN m USING (temperature_k) WHERE m1 >= 15""")
def _(t):
    o = obs(t)
    names = ["ln_gamma_1_pred", "ln_gamma_2_pred"]
    out = i.apply_predictor(o.filter("m1 >= 15"), i.baseline_predictor(o.filter("m1 < 15")))
    return round_columns(out.select("row_id", *names), names)
