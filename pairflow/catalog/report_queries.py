"""Report tables (K1-K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.aggregate_queries import PREDICTED, predicted
from pairflow.catalog.registry import query, round_columns
from pairflow.catalog.views import OBS, obs
from pairflow.functions import fixed
from pairflow.operators import reports as k
from pairflow.operators.aggregates import group_mean
from pairflow.operators.vectors import pca_scores
from pairflow.operators.sizing import measured


@query("k1_parity_points", f"""
WITH {OBS}, {PREDICTED}
SELECT row_id, 'ln_gamma_1' AS target, round(ln_gamma_1, 6) + 0.0 AS truth, round(p1, 6) + 0.0 AS pred FROM pred
UNION ALL SELECT row_id, 'ln_gamma_2', round(ln_gamma_2, 6) + 0.0, round(p2, 6) + 0.0 FROM pred""")
def _(t):
    return round_columns(k.parity_points(predicted(t)), ["truth", "pred"])


def _label_sql(y, p):
    return f"""SELECT '{y}' AS target, holdout_set, round(min({y}), 6) + 0.0 AS line_min, round(max({y}), 6) + 0.0 AS line_max,
  'RMSE = ' || printf('%.3f', sqrt(avg(pow({y} - {p}, 2)))) AS rmse_label, 'MAE = ' || printf('%.3f', avg(abs({y} - {p}))) AS mae_label,
  'R2 = ' || printf('%.3f', 1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count(*))) AS r2_label FROM pred GROUP BY holdout_set"""


@query("k1_parity_table", f"WITH {OBS}, {PREDICTED} {_label_sql('ln_gamma_1', 'p1')} UNION ALL {_label_sql('ln_gamma_2', 'p2')}")
def _(t):
    return round_columns(k.parity_table(predicted(t), by=["holdout_set"]), ["line_min", "line_max"])


@query("k2_error_vs", f"""
WITH {OBS}, {PREDICTED}
SELECT x1, round(abs(ln_gamma_1 - p1), 6) AS abs_error_1, round(abs(ln_gamma_2 - p2), 6) AS abs_error_2 FROM pred""")
def _(t):
    return round_columns(k.error_vs(predicted(t), "x1"), ["abs_error_1", "abs_error_2"])


@query("k3_cluster_count_table", "SELECT p_brand AS cluster, count(*) AS n, round(log10(count(*)), 6) AS height FROM part GROUP BY 1")
def _(t):
    return round_columns(k.cluster_count_table(t.part.withColumnRenamed("p_brand", "cluster"), log_scale=True), ["height"])


@query("k4_distribution_compare", f"""
WITH v AS (SELECT 'events' AS source, value AS v FROM events UNION ALL SELECT 'orders', (o_totalprice - 200000) / 4000 FROM orders),
e AS (SELECT unnest({fixed.HISTOGRAM_EDGES[:-1]}) AS lo, unnest({fixed.HISTOGRAM_EDGES[1:]}) AS hi),
b AS (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS bin FROM e)
SELECT source, bin, lo::DOUBLE AS bin_lo, hi::DOUBLE AS bin_hi,
  (SELECT count(*) FROM v WHERE v.source = s.source AND v >= lo AND (v < hi OR (hi = 60 AND v = 60))) AS n
FROM (SELECT DISTINCT source FROM v) s, b""")
def _(t):
    orders = t.orders.select(((F.col("o_totalprice") - 200000) / 4000).alias("value"))
    return k.distribution_compare({"events": t.events, "orders": orders}, "value")


@query("k5_observed_vs_reference", f"""
WITH {OBS}, r AS (SELECT m1, m2, temperature_k, x1, avg(ln_gamma_1) AS p1, avg(ln_gamma_2) AS p2 FROM obs WHERE m1 < 20 GROUP BY ALL),
j AS (SELECT * FROM obs JOIN r USING (m1, m2, temperature_k, x1))
SELECT count(*) AS n, round(sqrt(avg(pow(ln_gamma_1 - p1, 2))), 6) AS ln_gamma_1_rmse, round(sqrt(avg(pow(ln_gamma_2 - p2, 2))), 6) AS ln_gamma_2_rmse,
  round(avg(abs(ln_gamma_1 - p1)), 6) AS ln_gamma_1_mae, round(avg(abs(ln_gamma_2 - p2)), 6) AS ln_gamma_2_mae,
  round(1 - sum(pow(ln_gamma_1 - p1, 2)) / (var_pop(ln_gamma_1) * count(*)), 6) AS ln_gamma_1_r2,
  round(1 - sum(pow(ln_gamma_2 - p2, 2)) / (var_pop(ln_gamma_2) * count(*)), 6) AS ln_gamma_2_r2 FROM j""")
def _(t):
    keys = ["m1", "m2", "temperature_k", "x1"]
    reference = measured(group_mean(obs(t).filter("m1 < 20"), keys, ["ln_gamma_1", "ln_gamma_2"]))
    scores = k.observed_vs_reference(obs(t), reference, keys, ["temperature_k", "x1"])
    return round_columns(scores, [c for c in scores.columns if c != "n"])


@query("k6_embedding_scatter")
def _(t):
    scores = pca_scores(t.embeddings, "embedding")
    return k.embedding_scatter(scores, "label", 5, ["vec_id", "PC1", "PC2"])


@query("k7_group_curves", f"""
WITH {OBS}, {PREDICTED}, f AS (SELECT DISTINCT m1, m2, temperature_k FROM obs ORDER BY 1, 2, 3 LIMIT 5)
SELECT m1, m2, temperature_k, x1, round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1, round(ln_gamma_2, 6) + 0.0 AS ln_gamma_2,
       round(p1, 6) + 0.0 AS ln_gamma_1_pred, round(p2, 6) + 0.0 AS ln_gamma_2_pred FROM pred JOIN f USING (m1, m2, temperature_k)""")
def _(t):
    names = ["ln_gamma_1", "ln_gamma_2", "ln_gamma_1_pred", "ln_gamma_2_pred"]
    return round_columns(k.group_curves(predicted(t)), names)
