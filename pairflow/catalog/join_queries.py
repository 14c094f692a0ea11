"""Joins (C1-C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.registry import query, round_columns
from pairflow.catalog.views import KEYED, OBS, REGISTRY, ROLES, keyed, obs, part_dim, registry_dim, registry_or_name, roles
from pairflow.operators import joins as j
from pairflow.operators.aggregates import group_mean
from pairflow.operators.select import suffix_columns
from pairflow.operators.sizing import measured

# Customers resolved by name; every seventh is missing from the dimension.
NAMES = """names AS (
  SELECT c_name AS name, c_mktsegment || '/' || c_custkey AS smiles FROM customer WHERE c_custkey % 7 <> 0),
named AS (
  SELECT o_orderkey, c_name AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS smiles
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _names(t):
    known = t.customer.filter(F.col("c_custkey") % 7 != 0)
    value = F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string"))
    return known.select(F.col("c_name").alias("name"), value.alias("smiles"))


def _named(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.col("c_name").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "old").alias("smiles"))


@query("c1_enrich_left", f"""
WITH {NAMES}
SELECT o_orderkey, a.name, b.smiles FROM named a LEFT JOIN names b ON a.name = b.name""")
def _(t):
    return j.enrich_left(_named(t), _names(t), "name", "smiles")


@query("c1_enrich_first_listed", """
WITH first AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1)
SELECT c_custkey, priority FROM customer LEFT JOIN first ON c_custkey = o_custkey""")
def _(t):
    """Of a customer's orders the first by date."""
    dim = t.orders.withColumnRenamed("o_orderpriority", "priority")
    return j.enrich_left(t.customer.select("c_custkey"), dim, "c_custkey", "priority", dim_key="o_custkey", order=["o_orderdate", "o_orderkey"])


@query("c2_enrich_coalesce", f"""
WITH {NAMES}
SELECT o_orderkey, a.name, coalesce(b.smiles, a.smiles) AS smiles FROM named a LEFT JOIN names b ON a.name = b.name""")
def _(t):
    return j.enrich_coalesce(_named(t), _names(t), "name", "smiles")


@query("c3_resolve_pair", f"""
WITH {OBS}, dim AS (SELECT n_nationkey AS id, n_name AS smiles FROM nation WHERE n_nationkey % 7 <> 0)
SELECT row_id, m1 AS cas_number_1, m2 AS cas_number_2, a.smiles AS smiles_1, b.smiles AS smiles_2
FROM obs JOIN dim a ON m1 = a.id JOIN dim b ON m2 = b.id""")
def _(t):
    pairs = obs(t).select("row_id", F.col("m1").alias("cas_number_1"), F.col("m2").alias("cas_number_2"))
    dim = t.nation.filter(F.col("n_nationkey") % 7 != 0)
    return j.resolve_pair(pairs, dim, "cas_number", "smiles", "n_nationkey", "n_name")


@query("c4_resolve_with_fallback", f"""
WITH {KEYED},
by_key AS (SELECT cas_number, min(smiles) AS smiles FROM part_dim GROUP BY cas_number),
by_name AS (SELECT solvent_name, min(smiles) AS smiles FROM part_dim GROUP BY solvent_name)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, cas_number_1,
       CASE WHEN cas_number_1 LIKE 'part %' THEN n.smiles ELSE k.smiles END AS smiles_1
FROM keyed LEFT JOIN by_key k ON cas_number_1 = k.cas_number LEFT JOIN by_name n ON cas_number_1 = n.solvent_name""")
def _(t):
    dim = part_dim(t)
    return j.resolve_with_fallback(keyed(t), dim, "cas_number_1", "cas_number", "solvent_name", "smiles", "smiles_1")


@query("c4_resolve_pair_with_fallback", f"""
WITH {OBS}, {REGISTRY}
SELECT row_id, a.id AS cas_number_1, b.id AS cas_number_2, a.smiles AS smiles_1, b.smiles AS smiles_2
FROM obs JOIN registry a ON m1 = a.k JOIN registry b ON m2 = b.k WHERE a.smiles IS NOT NULL AND b.smiles IS NOT NULL""")
def _(t):
    """Both sides by registry id or by name; pairs with an unknown side go."""
    pairs = obs(t).select("row_id", registry_or_name("m1").alias("cas_number_1"), registry_or_name("m2").alias("cas_number_2"))
    return j.resolve_pair_with_fallback(pairs, registry_dim(t), "cas_number", "smiles", "cas_number", "solvent_name", "smiles")


@query("c5_lookup_by_type", f"""
WITH {KEYED}, d AS (SELECT solvent_name, min(cas_number) AS unique_code FROM part_dim GROUP BY solvent_name)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, cas_number_1, unique_code
FROM keyed LEFT JOIN d ON cas_number_1 = solvent_name""")
def _(t):
    columns = {"CAS": "cas_number", "NAME": "solvent_name", "SMILES": "smiles"}
    dim = part_dim(t).withColumn("unique_code", F.col("cas_number"))
    return j.lookup_by_type(keyed(t), dim, "cas_number_1", "NAME", columns, "unique_code")


@query("c6_unresolved", f"""
WITH {NAMES} SELECT o_orderkey, name, smiles FROM named WHERE name NOT IN (SELECT name FROM names)""")
def _(t):
    return j.unresolved(_named(t), _names(t), "name")


MEANS = """means AS (
  SELECT m1, m2, temperature_k, x1, avg(ln_gamma_1) AS p1, avg(ln_gamma_2) AS p2 FROM obs GROUP BY ALL)"""


@query("c7_join_inner_keys", f"""
WITH {OBS}, g AS (SELECT m1, m2, temperature_k, avg(x1) AS x_mean FROM obs GROUP BY ALL HAVING count(*) >= 4)
SELECT row_id, m1, m2, temperature_k, round(x_mean, 6) + 0.0 AS x_mean FROM obs JOIN g USING (m1, m2, temperature_k)""")
def _(t):
    o = obs(t)
    groups = o.groupBy("m1", "m2", "temperature_k").agg(F.avg("x1").alias("x_mean"), F.count("*").alias("n")).filter("n >= 4")
    return round_columns(j.join_inner_keys(o.select("row_id", "m1", "m2", "temperature_k"), measured(groups.drop("n"))), ["x_mean"])


def _means(t):
    means = group_mean(obs(t), ["m1", "m2", "temperature_k", "x1"], ["ln_gamma_1", "ln_gamma_2"])
    return measured(means.filter("x1 < 0.75"))


@query("c8_join_left_keys", f"""
WITH {OBS}, {MEANS}
SELECT row_id, o.m1, o.m2, o.x1, round(p1, 6) + 0.0 AS ln_gamma_1_pred, round(p2, 6) + 0.0 AS ln_gamma_2_pred
FROM obs o LEFT JOIN means p ON o.m1 = p.m1 AND o.m2 = p.m2 AND o.temperature_k = p.temperature_k AND o.x1 = p.x1 AND p.x1 < 0.75""")
def _(t):
    joined = j.join_left_keys(obs(t), _means(t), ["m1", "m2", "temperature_k", "x1"], ["temperature_k", "x1"])
    return round_columns(joined.select("row_id", "m1", "m2", "x1", "ln_gamma_1_pred", "ln_gamma_2_pred"), ["ln_gamma_1_pred", "ln_gamma_2_pred"])


@query("c9_join_many_to_many", f"""
WITH {OBS}, {MEANS}
SELECT row_id, round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1, round(p1, 6) + 0.0 AS ln_gamma_1_pred
FROM obs o JOIN means p USING (m1, m2, temperature_k, x1) WHERE p.x1 < 0.75""")
def _(t):
    joined = j.join_many_to_many(obs(t), _means(t), ["m1", "m2", "temperature_k", "x1"], ["x1"])
    return round_columns(joined.select("row_id", "ln_gamma_1", "ln_gamma_1_pred"), ["ln_gamma_1", "ln_gamma_1_pred"])


@query("c10_pairs_within", f"""
WITH {OBS}, {ROLES}
SELECT row_id, m1, m2 FROM obs WHERE m1 IN (SELECT id FROM roles WHERE role = 'train') AND m2 IN (SELECT id FROM roles WHERE role = 'train')""")
def _(t):
    return j.pairs_within(obs(t), roles(t).filter("role = 'train'"), "id").select("row_id", "m1", "m2")


@query("c11_pairs_across", f"""
WITH {OBS}, {ROLES}
SELECT row_id, m1, m2 FROM obs JOIN roles a ON m1 = a.id JOIN roles b ON m2 = b.id
WHERE (a.role = 'train' AND b.role = 'valid') OR (a.role = 'valid' AND b.role = 'train')""")
def _(t):
    r = roles(t)
    across = j.pairs_across(obs(t), r.filter("role = 'train'"), r.filter("role = 'valid'"), "id")
    return across.select("row_id", "m1", "m2")


@query("c12_all_pairs", """
WITH e AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS pair_index, a.i AS i, b.i AS j, a.s_name AS s_name_1, b.s_name AS s_name_2
FROM e a JOIN e b ON a.i < b.i""")
def _(t):
    return j.all_pairs(t.supplier, ["s_suppkey"], ["s_name"], block=32)


@query("c13_zip_by_row", f"""
WITH {OBS}
SELECT row_id, m1, m2, temperature_k, x1, round(ln_gamma_1 * 2, 6) + 0.0 AS ln_gamma_1_pred FROM obs""")
def _(t):
    o = obs(t)
    truth, features = o.select("row_id", "m1", "m2"), o.select("row_id", "temperature_k", "x1")
    preds = suffix_columns(o.select("row_id", (F.col("ln_gamma_1") * 2).alias("ln_gamma_1")), "_pred", keep=["row_id"])
    return round_columns(j.zip_by_row(truth, features, preds), ["ln_gamma_1_pred"])


@query("c14_attach_label", """
SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return j.attach_label(t.documents.select("doc_id", "source"), t.labels.select("doc_id", "quality"), "doc_id")
