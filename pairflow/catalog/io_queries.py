"""Sources, sinks and incremental ingestion, written and read back (A1-A13, L1)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pairflow.catalog.registry import query, round_columns
from pairflow.catalog.views import OBS, ROLES, obs, roles
from pairflow.operators.splits import assign_pair_splits
from pairflow.session import scratch_path
from pairflow.sources import readers as r
from pairflow.sources import writers as w
from pairflow.sources.blocks import parse_block_lines, parse_block_text, parse_blocks, format_blocks, write_block_folders
from pairflow.streaming.ingest import ingest_blocks_incremental

CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


@query("a1_scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return r.scan_parquet(t.spark, t.path("orders")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("a2_scan_csv", """
SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def _(t):
    path = scratch_path(t.spark, "csv")
    segment = F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 5 == 1, "nan").otherwise(F.col("c_mktsegment"))
    rows = t.customer.select(F.col("c_custkey").alias("Unnamed: 0"), "c_custkey", "c_name", "c_acctbal", segment.alias("c_mktsegment"))
    rows.write.option("header", True).csv(path)
    return r.scan_csv(t.spark, path, CUSTOMER)


@query("a3_scan_csv_batches", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def _(t):
    path = scratch_path(t.spark, "batches")
    whole = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    t.customer.filter("c_custkey % 2 = 0").select(*whole).write.option("header", True).csv(f"{path}/batch_0.csv")
    t.customer.filter("c_custkey % 2 = 1").select("c_mktsegment", "c_custkey", "c_name").write.option("header", True).csv(f"{path}/batch_1.csv")
    return r.scan_csv_batches(t.spark, f"{path}/batch_*.csv", CUSTOMER)


@query("a4_scan_tagged_files", """
SELECT c_custkey, NULL::BIGINT AS s_suppkey, 'customer' AS source FROM customer UNION ALL SELECT NULL, s_suppkey, 'supplier' FROM supplier""")
def _(t):
    tagged = r.scan_tagged_files(t.spark, f"{t.folder}/{{customer,supplier}}.parquet", mergeSchema="true")
    return tagged.select("c_custkey", "s_suppkey", "source")


PARSED = f"""
WITH {OBS}
SELECT CAST(m1 AS VARCHAR) AS id_1, CAST(m2 AS VARCHAR) AS id_2, temperature_k, x1, round(1 - x1, 4) + 0.0 AS x2,
       round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1, round(ln_gamma_2, 6) + 0.0 AS ln_gamma_2 FROM obs"""


def _parsed(df):
    return round_columns(df.select("id_1", "id_2", "temperature_k", "x1", "x2", "ln_gamma_1", "ln_gamma_2"), ["ln_gamma_1", "ln_gamma_2"])


@query("a6_parse_block_text", PARSED)
def _(t):
    path = scratch_path(t.spark, "blocks")
    write_block_folders(obs(t), path)
    return _parsed(parse_block_text(t.spark, path, ids="folder"))


@query("a6_parse_block_lines", PARSED)
def _(t):
    path = scratch_path(t.spark, "blocks")
    write_block_folders(obs(t), path)
    return _parsed(parse_block_lines(t.spark, path, ids="folder"))


@query("a6_parse_blocks", f"""
WITH {OBS}
SELECT row_id, block::INTEGER AS block, CAST(m1 AS VARCHAR) AS id_1, CAST(m2 AS VARCHAR) AS id_2, CAST(m1 AS VARCHAR) AS names_1,
       CAST(m2 AS VARCHAR) AS names_2, round(x1, 4) AS x1, round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1 FROM obs, range(0, 2) b(block)""")
def _(t):
    """Two blocks and an incomplete tail per text."""
    one = format_blocks(obs(t))
    path = F.concat_ws("", F.lit("/x/"), "m1", F.lit("__"), "m2", F.lit("_ct.tab"))
    files = one.select("row_id", path.alias("path"), F.concat_ws("\n", "text", "text", F.lit("tail\ntail\n")).alias("text"))
    parsed = parse_blocks(files, carry=["row_id"])
    return round_columns(parsed.select("row_id", "block", "id_1", "id_2", "names_1", "names_2", "x1", "ln_gamma_1"), ["ln_gamma_1"])


@query("a8_write_parquet_counted", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count FROM orders")
def _(t):
    done = w.write_parquet_counted(t.orders.select("o_orderkey", "o_totalprice"), scratch_path(t.spark, "parquet"))
    return t.spark.read.parquet(done.path).withColumn("row_count", F.lit(done.row_count))


@query("a9_write_csv_counted", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer) AS row_count FROM customer")
def _(t):
    done = w.write_csv_counted(t.customer.drop("c_nationkey"), scratch_path(t.spark, "csv"), index="c_custkey")
    return r.scan_csv(t.spark, done.path, CUSTOMER).withColumn("row_count", F.lit(done.row_count))


@query("a10_write_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id FROM orders")
def _(t):
    path = scratch_path(t.spark, "batches")
    w.write_batches(t.orders.select("o_orderkey", "o_totalprice"), path, 1000, ["o_orderkey"])
    return t.spark.read.parquet(path).select("o_orderkey", F.col("batch_id").cast("long"))


@query("a11_write_scores_json", """
SELECT o_orderpriority AS model_name, o_orderstatus AS holdout_set, round(avg(o_totalprice), 4) AS rmse FROM orders GROUP BY 1, 2""")
def _(t):
    path = scratch_path(t.spark, "json")
    scores = t.orders.groupBy(F.col("o_orderpriority").alias("model_name"), F.col("o_orderstatus").alias("holdout_set"))
    w.write_scores_json(scores.agg(F.round(F.avg("o_totalprice"), 4).alias("rmse")), path)
    return t.spark.read.schema("model_name string, holdout_set string, rmse double").json(path)


SPLIT_STEPS = """
base AS (SELECT o.*, a.role AS r1, b.role AS r2 FROM obs o JOIN roles a ON m1 = a.id JOIN roles b ON m2 = b.id),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY md5('1995:' || row_id)) AS rn, count(*) OVER () AS n FROM base WHERE r1 = 'train' AND r2 = 'train'),
s AS (SELECT base.*, CASE WHEN rn <= floor((1.0::DOUBLE - 0.01::DOUBLE) * n) THEN 'train' WHEN rn IS NOT NULL THEN 'valid_cont'
  WHEN r1 = 'valid' AND r2 = 'valid' THEN 'valid_indp' WHEN r1 = 'test' AND r2 = 'test' THEN 'test_indp'
  WHEN 'train' IN (r1, r2) AND 'valid' IN (r1, r2) THEN 'valid_mix' WHEN 'train' IN (r1, r2) THEN 'test_mix' END AS split
  FROM base LEFT JOIN ranked USING (row_id))"""
SPLIT_OF = f"""
WITH {OBS}, {ROLES}, {SPLIT_STEPS}"""


@query("a12_write_split_tables", f"{SPLIT_OF} SELECT split, row_id, m1, m2, temperature_k, x1, round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1 FROM s WHERE split IS NOT NULL")
def _(t):
    splits = assign_pair_splits(obs(t), roles(t), "id")
    data, features = w.write_split_tables(splits, scratch_path(t.spark, "splits"))
    joined = t.spark.read.parquet(data).join(t.spark.read.parquet(features), ["split", "row_id"])
    return round_columns(joined.select("split", "row_id", "m1", "m2", "temperature_k", "x1", "ln_gamma_1"), ["ln_gamma_1"])


@query("a13_write_index_list", f"{SPLIT_OF} SELECT row_id FROM s WHERE split = 'test_indp'")
def _(t):
    path = scratch_path(t.spark, "index")
    chosen = assign_pair_splits(obs(t), roles(t), "id").filter("split = 'test_indp'")
    w.write_index_list(chosen, path, compress=True)
    return t.spark.read.text(path).withColumnRenamed("value", "row_id")


@query("l1_ingest_blocks_incremental", PARSED)
def _(t):
    """Results arrive in two portions; a third run finds nothing new."""
    path, out, checkpoint = (scratch_path(t.spark, n) for n in ("arrivals", "parsed", "progress"))
    o = obs(t)
    write_block_folders(o.filter("m1 < 12"), f"{path}/first")
    ingest_blocks_incremental(t.spark, f"{path}/*/*", out, checkpoint, ids="folder")
    write_block_folders(o.filter("m1 >= 12"), f"{path}/second")
    ingest_blocks_incremental(t.spark, f"{path}/*/*", out, checkpoint, ids="folder")
    return _parsed(ingest_blocks_incremental(t.spark, f"{path}/*/*", out, checkpoint, ids="folder"))
