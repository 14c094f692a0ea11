"""Set operations, sorts and limits (A5, F1-F3, G1-G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.registry import query, round_columns
from pairflow.catalog.views import OBS, obs
from pairflow.operators import sets as g

ERRORS = """errors AS (
  SELECT row_id, m1, m2, temperature_k, x1, CASE WHEN x1 > 0 THEN abs(ln_gamma_1 - ln_gamma_2) END AS err FROM obs)"""


def _errors(t):
    err = F.when(F.col("x1") > 0, F.abs(F.col("ln_gamma_1") - F.col("ln_gamma_2")))
    return obs(t).select("row_id", "m1", "m2", "temperature_k", "x1", err.alias("err"))


@query("a5_scan_limit", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 1000")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return g.scan_limit(t.lineitem.select(*keys), 1000, keys)


@query("f1_sort_scores", """
SELECT row_number() OVER (ORDER BY holdout_set, model_name) AS pos, holdout_set, model_name, n FROM (
  SELECT o_orderstatus AS holdout_set, o_orderpriority AS model_name, count(*) AS n FROM orders GROUP BY ALL)""")
def _(t):
    scores = t.orders.groupBy(F.col("o_orderstatus").alias("holdout_set"), F.col("o_orderpriority").alias("model_name")).agg(
        F.count("*").alias("n")
    )
    return g.sort_scores(scores).withColumn("pos", F.expr("row_number() over (order by holdout_set, model_name)"))


@query("f2_worst_or_best_rows", f"""
WITH {OBS}, {ERRORS}
SELECT row_id, round(err, 6) AS err FROM errors WHERE err IS NOT NULL ORDER BY errors.err DESC, row_id LIMIT 100""")
def _(t):
    return round_columns(g.worst_or_best_rows(_errors(t), "err", 100, ascending=False).select("row_id", "err"), ["err"])


@query("f3_first_n_groups", f"""
WITH {OBS}, f AS (SELECT DISTINCT m1, m2, temperature_k FROM obs ORDER BY 1, 2, 3 LIMIT 5)
SELECT row_id, m1, m2, temperature_k, x1 FROM obs JOIN f USING (m1, m2, temperature_k)""")
def _(t):
    return g.first_n_groups(obs(t).select("row_id", "m1", "m2", "temperature_k", "x1"))


@query("g1_union_tagged", """
SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment, NULL AS s_suppkey, 'Train' AS split FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey, 'Test' FROM supplier""")
def _(t):
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    suppliers = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return g.union_tagged({"Train": customers, "Test": suppliers})


@query("g2_union_distinct", """
SELECT DISTINCT entity FROM (SELECT l_partkey AS entity FROM lineitem UNION ALL SELECT nullif(l_suppkey, 5) FROM lineitem)
WHERE entity IS NOT NULL""")
def _(t):
    return g.union_distinct(t.lineitem.select("l_partkey", F.nullif("l_suppkey", F.lit(5)).alias("b")), ["l_partkey", "b"])


@query("g3_complement", f"""
WITH {OBS} SELECT row_id, m1, m2 FROM obs WHERE NOT (x1 > 0.45)""")
def _(t):
    o = obs(t).select("row_id", "m1", "m2", "x1")
    return g.complement(o, o.filter("x1 > 0.45")).drop("x1")
