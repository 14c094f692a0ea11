"""Operators that depend on order, and splits (E1-E8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.registry import query
from pairflow.catalog.views import OBS, ROLES, mol, obs, roles
from pairflow.operators import ordering as e
from pairflow.operators.splits import assign_pair_splits, greedy_cluster_split

LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INTEGER"


def _lines(t):
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.col("l_quantity").cast("int").cast("string"))
    return t.lineitem.select(key.alias("row_id"), "l_orderkey")


@query("e1_row_index", f"""
SELECT row_id, row_number() OVER (ORDER BY l_orderkey, row_id) - 1 AS row_index FROM (SELECT {LINE_ID} AS row_id, l_orderkey FROM lineitem)""")
def _(t):
    return e.row_index(_lines(t), ["l_orderkey", "row_id"]).select("row_id", "row_index")


@query("e2_batch_id", f"""
SELECT row_id, (row_number() OVER (ORDER BY l_orderkey, row_id) - 1) // 1000 AS batch_id FROM (SELECT {LINE_ID} AS row_id, l_orderkey FROM lineitem)""")
def _(t):
    return e.batch_id(e.row_index(_lines(t), ["l_orderkey", "row_id"]), 1000).select("row_id", "batch_id")


# The walk over clusters in label order, as a recursive query.
WALK = """
WITH RECURSIVE c AS (SELECT {cluster} AS cluster, count(*) AS size FROM {table} GROUP BY 1),
n AS (SELECT cluster, size, row_number() OVER (ORDER BY cluster) AS k, sum(size) OVER () AS total FROM c),
w AS (
  SELECT 0::BIGINT AS k, NULL::{type} AS cluster, 0::BIGINT AS n_train, 0::BIGINT AS n_valid, NULL::VARCHAR AS role
  UNION ALL
  SELECT n.k, n.cluster,
    w.n_train + CASE WHEN w.n_train + n.size > {train} * n.total THEN 0 ELSE n.size END,
    w.n_valid + CASE WHEN w.n_train + n.size > {train} * n.total AND NOT w.n_train + w.n_valid + n.size > {upto} * n.total THEN n.size ELSE 0 END,
    CASE WHEN NOT w.n_train + n.size > {train} * n.total THEN 'train'
         WHEN w.n_train + w.n_valid + n.size > {upto} * n.total THEN 'test' ELSE 'valid' END
  FROM w JOIN n ON n.k = w.k + 1)
SELECT {key} AS id, w.cluster, w.role FROM {table} JOIN w ON w.cluster = {cluster}"""


def _walk_sql(table, key, cluster, kind, valid, test):
    train = f"(1.0::DOUBLE - {test}::DOUBLE - {valid}::DOUBLE)"
    return WALK.format(table=table, key=key, cluster=cluster, type=kind, train=train, upto=f"({train} + {valid}::DOUBLE)")


@query("e3_greedy_cluster_split", _walk_sql("part", "p_partkey", "p_brand", "VARCHAR", 0.05, 0.15))
def _(t):
    entities = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"))
    return greedy_cluster_split(entities, "cluster", 0.05, 0.15)


@query("e3_greedy_cluster_split_many", _walk_sql("orders", "o_orderkey", "o_custkey", "BIGINT", 0.2, 0.2))
def _(t):
    """More clusters than one array holds."""
    entities = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"))
    return greedy_cluster_split(entities, "cluster", 0.2, 0.2, chunk=400)


@query("e4_holdout_fraction", f"""
WITH {OBS}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('1995:' || row_id)) AS rn, count(*) OVER () AS n FROM obs)
SELECT row_id, CASE WHEN rn <= floor((1.0::DOUBLE - 0.01::DOUBLE) * n) THEN 'train' ELSE 'valid_cont' END AS part FROM r""")
def _(t):
    return e.holdout_fraction(obs(t).select("row_id"), 0.01, 1995)


@query("e5_random_split", """
WITH h AS (SELECT doc_id, ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS f FROM documents)
SELECT doc_id, CASE WHEN f < 0.8::DOUBLE THEN 'train' WHEN f < 0.8::DOUBLE + 0.1::DOUBLE THEN 'valid' ELSE 'test' END AS part FROM h""")
def _(t):
    weights = {"train": 0.8, "valid": 0.1, "test": 0.1}
    return e.random_split(t.documents.select("doc_id"), weights, seed=7, row_id="doc_id")


@query("e6_shuffle", f"""
WITH {OBS} SELECT row_id, row_number() OVER (ORDER BY md5('10:' || row_id), row_id) - 1 AS shuffled_index FROM obs""")
def _(t):
    return e.shuffled_index(obs(t).select("row_id"), 10)


@query("e7_first_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def _(t):
    first = e.first_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_totalprice")


TRAIN_RANK = """base AS (SELECT row_id, a.role AS r1, b.role AS r2 FROM obs JOIN roles a ON m1 = a.id JOIN roles b ON m2 = b.id),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY md5('1995:' || row_id)) AS rn, count(*) OVER () AS n
           FROM base WHERE r1 = 'train' AND r2 = 'train')"""


@query("e8_assign_pair_splits", f"""
WITH {OBS}, {ROLES}, {TRAIN_RANK}
SELECT row_id, CASE WHEN rn <= floor((1.0::DOUBLE - 0.01::DOUBLE) * n) THEN 'train' ELSE 'valid_cont' END AS split FROM ranked
UNION ALL SELECT row_id, 'valid_mix' FROM base WHERE (r1 = 'train' AND r2 = 'valid') OR (r1 = 'valid' AND r2 = 'train')
UNION ALL SELECT row_id, 'valid_indp' FROM base WHERE r1 = 'valid' AND r2 = 'valid'
UNION ALL SELECT row_id, 'test_mix' FROM base WHERE (r1 = 'train' AND r2 = 'test') OR (r1 = 'test' AND r2 = 'train')
UNION ALL SELECT row_id, 'test_indp' FROM base WHERE r1 = 'test' AND r2 = 'test'""")
def _(t):
    entities = greedy_cluster_split(mol(t), "cluster", 0.2, 0.2)
    return assign_pair_splits(obs(t), entities, "id").select("row_id", "split")


@query("e8_assign_pair_splits_compat", f"""
WITH {OBS}, {ROLES}, {TRAIN_RANK}
SELECT row_id, CASE WHEN rn <= floor((1.0::DOUBLE - 0.01::DOUBLE) * n) THEN 'train' ELSE 'valid_cont' END AS split FROM ranked
UNION ALL SELECT row_id, 'valid_mix' FROM base WHERE (r1 = 'train' AND r2 = 'valid') OR (r1 = 'valid' AND r2 = 'train')
UNION ALL SELECT row_id, 'valid_indp' FROM base WHERE r1 = 'valid'
UNION ALL SELECT row_id, 'test_mix' FROM base WHERE (r1 = 'train' AND r2 = 'test') OR (r1 = 'test' AND r2 = 'train')
UNION ALL SELECT row_id, 'test_indp' FROM base WHERE r1 = 'test' AND r2 = 'test'""")
def _(t):
    return assign_pair_splits(obs(t), roles(t), "id", strict=False).select("row_id", "split")
