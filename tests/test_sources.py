"""Readers, writers, block files and incremental ingestion."""

import gzip
import time

import pytest
from pyspark.sql import functions as F, types as T

from pairflow.catalog.registry import Tables
from pairflow.operators.groups import apply_per_group
from pairflow.operators.ordering import row_index
from pairflow.plans import jobs
from pairflow.schema import BATCH_SCHEMA
from pairflow.session import shared_dir, stored
from pairflow.sources import blocks, readers as r
from pairflow.sources import writers as w
from pairflow.sources.blocks import format_blocks, parse_block_lines, parse_block_text, write_block_folders
from pairflow.streaming.ingest import ingest_blocks_incremental

SCHEMA = T.StructType([T.StructField("smiles_1", T.StringType()), T.StructField("x(1)", T.DoubleType()), T.StructField("c0_0", T.DoubleType())])
OBS = "row_id string, m1 string, m2 string, temperature_k double, x1 double, ln_gamma_1 double, ln_gamma_2 double"


def obs(spark, m1="a"):
    return spark.createDataFrame([(f"{m1}{k}", m1, "b(2),x", 300.0, k / 10, k / 4, -k / 8) for k in range(3)], OBS)


def test_csv_missing_words_and_index_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',smiles_1,x(1),c0_0\n0,CCO,0.5,NA\n1,null,nan,1.5\n2,"a,b",bad,\n')
    got = [tuple(x) for x in r.scan_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()]
    assert got == [("CCO", 0.5, None), (None, None, 1.5), ("a,b", None, None)]


def test_batches_match_columns_by_name(spark, tmp_path):
    (tmp_path / "batch_0.csv").write_text("smiles_1,x(1),c0_0\nA,0.1,1.0\n")
    (tmp_path / "batch_1.csv").write_text("x(1),smiles_1\n0.2,B\n")
    (tmp_path / "batch_2.csv").write_text("smiles_1,x(1),c0_0\nC,0.3,3.0\n")
    got = r.scan_csv_batches(spark, str(tmp_path / "batch_*.csv"), SCHEMA).orderBy("smiles_1").collect()
    assert [tuple(x) for x in got] == [("A", 0.1, 1.0), ("B", 0.2, None), ("C", 0.3, 3.0)]
    alike = r.scan_csv_batches(spark, [str(tmp_path / f"batch_{k}.csv") for k in (0, 2)], SCHEMA, one_layout=True)
    assert alike.count() == 2


def test_tagged_files(spark, tmp_path):
    for name in ("train_preds", "test.v2"):
        (tmp_path / f"{name}.csv").write_text("a\n1\n")
    got = r.scan_tagged_files(spark, str(tmp_path / "*.csv"), "csv", header="true")
    assert sorted(x["source"] for x in got.collect()) == ["test.v2", "train_preds"]


def test_counted_writers(spark, tmp_path):
    done = w.write_parquet_counted(obs(spark), str(tmp_path / "p"))
    assert done.row_count == 3 and spark.read.parquet(done.path).count() == 3
    done = w.write_csv_counted(obs(spark).repartition(3), str(tmp_path / "c"), index="row_id")
    assert done.row_count == 3 and spark.read.option("header", True).csv(done.path).columns[0] == "row_id"
    with pytest.raises(TypeError, match="not supported"):
        w.write_parquet_counted([1, 2], str(tmp_path / "x"))


def test_batches_and_index_list(spark, tmp_path):
    w.write_batches(spark.range(25), str(tmp_path / "b"), 10, ["id"])
    back = spark.read.parquet(str(tmp_path / "b")).groupBy("batch_id").agg(F.min("id"), F.max("id"), F.count("*"))
    assert [tuple(x) for x in back.orderBy("batch_id").collect()] == [(0, 0, 9, 10), (1, 10, 19, 10), (2, 20, 24, 5)]
    w.write_index_list(obs(spark).coalesce(1), str(tmp_path / "i"), compress=True)
    (file,) = (tmp_path / "i").glob("*.gz")
    assert gzip.open(file, "rt").read().split() == ["a0", "a1", "a2"]


def test_split_tables_share_row_ids(spark, tmp_path):
    data, features = w.write_split_tables(obs(spark).withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "data" / "split=train").is_dir()
    both = spark.read.parquet(data).join(spark.read.parquet(features), ["split", "row_id"])
    assert both.count() == 3 and set(both.columns) >= {"m1", "ln_gamma_1", "x1", "temperature_k"}


def write_file(folder, name, df):
    text = "\n".join(x["text"] for x in format_blocks(df).orderBy("x1").collect())
    (folder / name).write_text(text + "\n")


def test_block_files_with_awkward_names(spark, tmp_path):
    write_file(tmp_path, "64-17-5__n (1)+2_ct.tab", obs(spark))
    got = parse_block_text(spark, str(tmp_path / "*.tab")).orderBy("block").collect()
    assert [(x["id_1"], x["id_2"], x["names_2"], x["block"], x["x1"]) for x in got] == [
        ("64-17-5", "n (1)+2", "b(2),x", k, k / 10) for k in range(3)
    ]
    with pytest.raises(ValueError):
        parse_block_text(spark, str(tmp_path), ids="header")


def test_block_folders(spark, tmp_path):
    write_block_folders(obs(spark).union(obs(spark, "c: d+e")), str(tmp_path / "f"), rows_per_file=2)
    got = parse_block_text(spark, str(tmp_path / "f"), ids="folder")
    assert got.count() == 6
    assert sorted({(x["id_1"], x["id_2"]) for x in got.collect()}) == [("a", "b(2),x"), ("c: d+e", "b(2),x")]


def test_late_batch_is_appended_once(spark, tmp_path):
    arrivals, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    arrivals.mkdir()
    write_file(arrivals, "a__b_ct.tab", obs(spark))
    write_file(arrivals, "c__b_ct.tab", obs(spark, "c"))
    run = lambda: ingest_blocks_incremental(spark, str(arrivals), str(out), str(progress))
    assert run().count() == 6
    write_file(arrivals, "d__b_ct.tab", obs(spark, "d"))
    assert run().count() == 9
    assert run().count() == 9
    want = parse_block_text(spark, str(arrivals))
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, want.collect()))


def test_jdbc_needs_a_driver(spark):
    with pytest.raises(Exception, match="[Dd]river"):
        r.scan_jdbc_table(spark, "jdbc:sqlite:/nowhere.db", "SearchResultSet", "id", (0, 10), 4)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == configured.rstrip("/") if configured else folder.startswith(("/tmp", "file:/tmp"))


def test_tables_are_read_lazily(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert Tables(spark, str(tmp_path)).t.count() == 3


def test_layouts_share_one_scan(spark, tmp_path, plan):
    (tmp_path / "a.csv").write_text('id,name,v\n1,"x, y",2.5\n2,n/a,\n\n')
    (tmp_path / "b.csv").write_text("v,id\n7.5,3\nv,id\n")
    (tmp_path / "c.csv").write_text('"name",other,id\nq,z,4\nr\n')
    (tmp_path / "d.csv").write_text("")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])
    df = r.scan_csv_batches(spark, f"{tmp_path}/*.csv", schema)
    assert plan(df).count("FileScan") == 1
    got = sorted((tuple(row) for row in df.collect()), key=str)
    assert got == sorted([(1, "x, y", 2.5), (2, None, None), (3, None, 7.5), (None, None, None), (4, "q", None), (None, "r", None)], key=str)


def test_many_batches_in_few_files(spark, tmp_path):
    path = f"{tmp_path}/batches"
    w.write_batches(spark.range(10_000).repartition(5), path, 1, ["id"], files=8)
    where = w.batch_files(spark, path).collect()
    assert len(where) == 10_000 and all(row["n"] == 1 for row in where) and len({row["file"] for row in where}) <= 8
    assert spark.read.parquet(path).filter("id = batch_id").count() == 10_000


@pytest.mark.parametrize("end", ["", "\n", "\r\ntail\r\nmore"])
def test_a_file_over_many_splits_is_numbered_through(spark, tmp_path, end):
    rows = [("a b", "c+d", float(k % 7) / 7, 300.0 + k, k / 10.0, -k / 10.0) for k in range(500)]
    df = spark.createDataFrame(rows, "smiles_1 string, smiles_2 string, x1 double, temperature_k double, ln_gamma_1 double, ln_gamma_2 double")
    texts = [row["text"] for row in format_blocks(df, ["smiles_1", "smiles_2"]).orderBy("temperature_k").collect()]
    text = "\n".join(texts)
    if "\r" in end:
        text = text.replace("\n", "\r\n")
    (tmp_path / "one__two_ct.tab").write_bytes((text + end).encode())
    (tmp_path / "short__x_ct.tab").write_bytes(b"only\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        scan = spark.read.text(f"{tmp_path}/*.tab")
        assert scan.rdd.getNumPartitions() > 10
        got = parse_block_lines(spark, f"{tmp_path}/*.tab").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = parse_block_text(spark, f"{tmp_path}/*.tab")
    columns = list(got[0].asDict())
    in_order = lambda found: sorted((tuple(row[c] for c in columns) for row in found), key=lambda t: t[columns.index("block")])
    assert len(got) == 500 and in_order(got) == in_order(want.collect())


def test_split_tables_without_rows(spark, tmp_path):
    none = obs(spark).withColumn("split", F.lit("train")).filter("x1 > 5")
    data, features = w.write_split_tables(none, str(tmp_path / "s"))
    assert spark.read.parquet(data).join(spark.read.parquet(features), ["split", "row_id"]).count() == 0


@pytest.mark.parametrize("end", ["", "\n", "\r\ntail\r\nmore"])
@pytest.mark.parametrize("whole", [0, 10_000, 8 << 20])
def test_small_files_whole_and_large_ones_by_lines(spark, tmp_path, monkeypatch, end, whole):
    monkeypatch.setattr(blocks, "WHOLE_BYTES", whole)
    monkeypatch.setattr(blocks, "WHOLE_PACKED", whole)
    df = spark.createDataFrame([("a", "b", float(k % 7) / 7, 300.0 + k, k / 10.0, -k / 10.0) for k in range(100)], "m1 string, m2 string, x1 double, temperature_k double, ln_gamma_1 double, ln_gamma_2 double")
    texts = [row["text"] for row in format_blocks(df).orderBy("temperature_k").collect()]
    for name, some in (("long", texts), ("short", texts[:3]), ("none", [])):
        text = "\n".join(some).replace("\n", "\r\n" if "\r" in end else "\n") + end
        (tmp_path / f"{name}__x_ct.tab").write_bytes(text.encode())
        with gzip.open(tmp_path / f"packed-{name}__x_ct.tab.gz", "wb") as f:
            f.write(text.encode())
    got = parse_block_lines(spark, f"{tmp_path}/*").collect()
    found = {n: sorted((r["block"], r["temperature_k"], r["names_2"], r["ln_gamma_2"]) for r in got if r["id_1"] == n) for n in {r["id_1"] for r in got}}
    want = [(k, 300.0 + k, "b", -k / 10.0) for k in range(100)]
    assert found == {"long": want, "packed-long": want, "short": want[:3], "packed-short": want[:3]}


def test_a_text_of_many_blocks_is_gone_through_once(spark):
    """100,000 lines of blocks in one text: cut chunk by chunk out of all lines, they took minutes."""
    block = "\n".join(["Property", "Settings", "T= 300.00 K ; x(1)= 0.5000 ; x(2)= 0.5000 ;", "Units", "Method", "Nr", "  1 a   0.250000", "  2 b   0.500000"])
    text = F.concat_ws("\n", F.array_repeat(F.lit(block), 12_500), F.lit("tail"))
    files = spark.range(1).select(F.lit("a__b_ct.tab").alias("path"), text.alias("text"))
    start = time.monotonic()
    n, last, total = blocks.parse_blocks(files).agg(F.count("*"), F.max("block"), F.sum("ln_gamma_1")).first()
    assert (n, last, total) == (12_500, 12_499, 3125.0) and time.monotonic() - start < 30


def test_long_tables_are_kept_packed(spark, tmp_path, plan):
    """Block files and batches are compressed, and rows are numbered and predicted over columns, not over a checkpoint."""
    blocks.write_block_folders(obs(spark), str(tmp_path / "f"))
    assert list((tmp_path / "f").rglob("part-*.gz")) and not list((tmp_path / "f").rglob("part-*.txt"))
    jobs.parse_job(spark, str(tmp_path / "f"), str(tmp_path / "b"), 2, ids="folder", compression="gzip")
    assert r.scan_csv_batches(spark, f"{tmp_path}/b/*.csv.gz", BATCH_SCHEMA).count() == 3
    predicted = apply_per_group(obs(spark), ["m1", "m2"], lambda key, rows: rows[["x1"]].rename(columns={"x1": "p"}), ["p"])
    for df in (row_index(obs(spark), ["row_id"]), predicted):
        assert "FileScan parquet" in plan(df)
    odd = stored(spark.range(2).withColumn("nothing", F.lit(None)))
    assert odd.count() == 2 and odd.columns == ["id", "nothing"]
