"""Views of the test tables in the shape the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairflow.catalog.registry import Tables
from pairflow.operators.sizing import measured

OBS = """obs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS row_id,
         s_nationkey AS m1, c_nationkey AS m2,
         CAST(year(l_shipdate) AS DOUBLE) AS temperature_k,
         round(l_discount * 10, 1) AS x1,
         ln(l_extendedprice) - 10.0 AS ln_gamma_1,
         ln(l_quantity) - 2.0 AS ln_gamma_2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""

# Entities with the roles that the greedy walk gives for 0.2 / 0.2 (checked in e3).
ROLES = """roles AS (
  SELECT n_nationkey AS id,
         CASE WHEN n_regionkey <= 2 THEN 'train' WHEN n_regionkey = 3 THEN 'valid' ELSE 'test' END AS role
  FROM nation)"""

# Observations over entities that are known by registry id or by name.
KEYED = """keyed AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_partkey,
         CASE WHEN l_partkey % 5 = 0 THEN 'part ' || l_partkey
              ELSE (100 + l_partkey % 900) || '-' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || '-' || (l_partkey % 10)
         END AS cas_number_1
  FROM lineitem JOIN part ON l_partkey = p_partkey),
part_dim AS (
  SELECT (100 + p_partkey % 900) || '-' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || '-' || (p_partkey % 10) AS cas_number,
         'part ' || p_partkey AS solvent_name,
         CASE WHEN p_partkey % 7 <> 0 THEN p_brand || '/' || p_partkey END AS smiles
  FROM part)"""


# Entities that are known by registry id or, every third, by name; every seventh has no value.
REGISTRY = """registry AS (
  SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS smiles,
         CASE WHEN n_nationkey % 3 = 0 THEN 'nation' || n_nationkey ELSE (100 + n_nationkey) || '-05-' || (n_nationkey % 10) END AS id
  FROM nation)"""


def obs(t: Tables) -> DataFrame:
    """Pair observations: supplier nation against customer nation."""
    buyers = measured(t.customer.select("c_custkey", "c_nationkey"))
    sellers = measured(t.supplier.select("s_suppkey", "s_nationkey"))
    ordered = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = (
        t.lineitem.repartition("l_orderkey")  # the key of the join with the orders; line items are shuffled once
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("int").cast("string"),
        ).alias("row_id"),
        F.col("s_nationkey").alias("m1"),
        F.col("c_nationkey").alias("m2"),
        F.year("l_shipdate").cast("double").alias("temperature_k"),
        F.round(F.col("l_discount") * 10, 1).alias("x1"),
        (F.ln("l_extendedprice") - F.lit(10.0)).alias("ln_gamma_1"),
        (F.ln("l_quantity") - F.lit(2.0)).alias("ln_gamma_2"),
    )


def mol(t: Tables) -> DataFrame:
    """Entities of ``obs``, clustered by region."""
    return t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).alias("cluster")
    )


def roles(t: Tables) -> DataFrame:
    role = F.when(F.col("cluster") <= 3, "train").when(F.col("cluster") == 4, "valid").otherwise("test")
    return mol(t).select("id", role.alias("role"))


def _registry_id(key: str):
    return F.concat(
        (F.lit(100) + F.col(key) % 900).cast("string"), F.lit("-"),
        F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit("-"), (F.col(key) % 10).cast("string"),
    )


def keyed(t: Tables) -> DataFrame:
    """Observations whose entity is given by registry id or, for every fifth, by name."""
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    by_name = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey",
        F.when(F.col("l_partkey") % 5 == 0, by_name).otherwise(_registry_id("l_partkey")).alias("cas_number_1"),
    )


def part_dim(t: Tables) -> DataFrame:
    """Entity dimension with every seventh value missing."""
    value = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    return t.part.select(
        _registry_id("p_partkey").alias("cas_number"),
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("solvent_name"),
        F.when(F.col("p_partkey") % 7 != 0, value).alias("smiles"),
    )


def _nation_id(key: str):
    return F.concat((F.lit(100) + F.col(key)).cast("string"), F.lit("-05-"), (F.col(key) % 10).cast("string"))


def registry_or_name(key: str):
    """Every third entity goes by a name, the others by a registry id."""
    return F.when(F.col(key) % 3 == 0, F.concat(F.lit("nation"), F.col(key).cast("string"))).otherwise(_nation_id(key))


def registry_dim(t: Tables) -> DataFrame:
    """Entity dimension by registry id and by name, with every seventh value missing."""
    return t.nation.select(
        _nation_id("n_nationkey").alias("cas_number"),
        F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("solvent_name"),
        F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("smiles"),
    )
