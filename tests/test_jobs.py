"""Staged jobs with a manifest, the registry of models, parse and dataset jobs."""

import pytest
from pyspark.sql import functions as F

from pairflow.plans import jobs
from pairflow.plans.stages import Stages, content_digest
from pairflow.schema import BATCH_SCHEMA, coefficient_names
from pairflow.sources.blocks import write_block_folders
from pairflow.sources.readers import scan_csv_batches

OBS = "row_id string, cas_number_1 string, cas_number_2 string, temperature_k double, x1 double, ln_gamma_1 double, ln_gamma_2 double"
NAMES = [f"{100 + k}-05-{k % 10}" for k in range(12)]
BOUNDS = {"ln_gamma_1": (-3.0, 3.0), "ln_gamma_2": (-3.0, 3.0)}


def observations(spark):
    rows = [
        (f"{a}-{b}-{k}", NAMES[a], NAMES[b], 300.0, k / 4, 9.0 if (a, b, k) == (0, 1, 2) else a / 10 + k / 8, b / 10 - k / 8)
        for a in range(12) for b in range(a + 1, 12) for k in range(3)
    ]
    return spark.createDataFrame(rows, OBS)


def entities(spark):
    """Entity 11 has no value, 10 only by the lookup; clusters of three."""
    rows = [(NAMES[k], f"C{k}" if k < 10 else None, k // 3) for k in range(12)]
    return spark.createDataFrame(rows, "cas_number string, smiles string, region long"), spark.createDataFrame([(NAMES[10], "O10")], "cas_number string, smiles string")


def split_job(spark, path, obs=None, **options):
    known, lookup = entities(spark)
    options = {"cluster": "region", "valid_size": 0.25, "test_size": 0.25} | options
    return jobs.staged_split_job(obs or observations(spark), known, lookup, path, BOUNDS, **options)


STAGES = ["limited", "known", "resolved", "clusters", "roles", "splits", "data", "features", "cluster_counts", "split_sizes"]


def test_restart_makes_each_stage_once(spark, tmp_path):
    path = str(tmp_path / "job")
    first = split_job(spark, path, until="roles")
    second = split_job(spark, path)
    third = split_job(spark, path)
    assert first.made == STAGES[:5] and second.made == STAGES[5:] and third.made == []
    records = third.manifest().collect()
    assert sorted(r["name"] for r in records) == sorted(STAGES)
    for r in records:
        assert spark.read.parquet(r["path"]).count() == r["n_rows"]


def test_staged_tables_agree_with_the_parts(spark, tmp_path):
    done = split_job(spark, str(tmp_path / "job"))
    groups = {tuple(r) for r in done["limited"].select("cas_number_1", "cas_number_2").distinct().collect()}
    assert len(groups) == 65 and (NAMES[0], NAMES[1]) not in groups  # one group out of range goes whole
    assert {r["smiles"] for r in done["known"].collect()} == {f"C{k}" for k in range(10)} | {"O10"}
    resolved = done["resolved"]
    assert resolved.count() == 3 * 54 and resolved.filter("smiles_1 is null or smiles_2 is null").count() == 0
    roles = dict(done["roles"].select("smiles", "role").collect())
    assert [roles[f"C{k}"] for k in (0, 3, 6, 9)] == ["train", "valid", "valid", "train"] or set(roles.values()) == {"train", "valid", "test"}
    label = {r["row_id"]: r["split"] for r in done["splits"].collect()}
    for r in resolved.collect():
        a, b = sorted((roles[r["smiles_1"]], roles[r["smiles_2"]]))
        expected = {("train", "train"): {"train", "valid_cont"}, ("train", "valid"): {"valid_mix"}, ("valid", "valid"): {"valid_indp"},
                    ("test", "train"): {"test_mix"}, ("test", "test"): {"test_indp"}}.get((a, b), {None})
        assert label.get(r["row_id"]) in expected
    data, features = done["data"], done["features"]
    assert data.join(features, ["split", "row_id"]).count() == len(label)
    assert {r["split"]: r["n_rows"] for r in done["split_sizes"].collect()} == {s: list(label.values()).count(s) for s in set(label.values())}


def test_new_inputs_and_settings_make_new_stages(spark, tmp_path):
    path = str(tmp_path / "job")
    split_job(spark, path)
    assert split_job(spark, path, holdout=0.5).made == ["splits", "data", "features", "split_sizes"]
    fewer = observations(spark).filter("row_id <> '2-3-1'")
    assert split_job(spark, path, obs=fewer).made == ["limited", "resolved", "splits", "data", "features", "split_sizes"]
    with pytest.raises(ValueError, match="unknown stage"):
        split_job(spark, path, until="nothing")


def test_a_stage_that_fails_leaves_no_record(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "job"))
    stages.source("numbers", spark.range(10))
    broken = lambda df: df.withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        stages.run("halved", broken, ["numbers"])
    again = Stages(spark, str(tmp_path / "job"))
    again.source("numbers", spark.range(10))
    assert again.manifest().count() == 0
    assert again.run("halved", lambda df: df.filter("id % 2 = 0"), ["numbers"]).count() == 5 and again.made == ["halved"]


def test_content_digest_minds_rows_but_not_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, v string")
    assert content_digest(a) == content_digest(a.orderBy(F.desc("k")).repartition(3))
    assert content_digest(a) != content_digest(a.dropDuplicates())
    assert content_digest(a) != content_digest(a.withColumnRenamed("v", "w"))
    assert content_digest(a.limit(0)) == content_digest(a.filter("k > 5"))


def splits(spark):
    rows = [(f"r{k}", s, "a", "b", 300.0, k / 4, 1.0 + k / 4, 2.0) for k, s in enumerate(["train", "valid_mix", "test_mix", "test_mix", None])]
    return spark.createDataFrame(rows, "row_id string, split string, m1 string, m2 string, temperature_k double, x1 double, ln_gamma_1 double, ln_gamma_2 double")


def models(spark):
    line = spark.createDataFrame([(300.0, 1.0, 1.0, 0.0, 2.5)], "temperature_k double, slope_1 double, intercept_1 double, slope_2 double, intercept_2 double")
    guesses = spark.createDataFrame([("r2", 1.0, 2.0), ("r3", 1.75, None)], "row_id string, ln_gamma_1_pred double, ln_gamma_2_pred double")
    curve = spark.createDataFrame([("a", "b", 300.0, 1.0, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0)], "m1 string, m2 string, temperature_k double, " + ", ".join(f"{c} double" for c in coefficient_names()))
    return [jobs.Model("line", "line", line), jobs.Model("guess", "predictions", guesses), jobs.Model("curve", "polynomial", curve), jobs.Model("same", "line", line)]


def test_models_of_all_kinds_are_scored_at_once(spark, tmp_path):
    out = str(tmp_path / "scores")
    scores = {(r["holdout_set"], r["model_name"]): r for r in jobs.evaluate_models_job(splits(spark), models(spark), out).collect()}
    assert set(scores) == {(s, m) for s in ("valid_mix", "test_mix") for m in ("line", "same", "curve")} | {("test_mix", "guess")}
    assert scores["test_mix", "curve"]["ln_gamma_1_rmse"] == 0.0 and scores["test_mix", "curve"]["ln_gamma_2_r2"] == 1.0
    assert scores["test_mix", "line"]["ln_gamma_2_mae"] == 0.5 and scores["test_mix", "line"]["ln_gamma_2_r2"] == 0.0
    assert scores["test_mix", "guess"]["ln_gamma_1_mae"] == 0.5  # the row without a whole prediction does not count
    assert spark.read.option("header", True).csv(f"{out}/csv").count() == 7
    table = [r["value"] for r in spark.read.text(f"{out}/latex").collect()]
    assert any(r.startswith("test\\_mix & curve & 0.0000 & 0.0000") and r.endswith("\\\\") for r in table)


def test_models_are_told_apart(spark):
    rows, known = splits(spark), models(spark)
    with pytest.raises(ValueError, match="differ"):
        jobs.evaluate_models_job(rows, [known[0], known[0]])
    with pytest.raises(ValueError, match="unknown kind"):
        jobs.evaluate_models_job(rows, [jobs.Model("x", "oracle", known[0].table)])
    with pytest.raises(ValueError, match="no models"):
        jobs.evaluate_models_job(rows, [])


def test_parse_and_dataset_jobs(spark, tmp_path):
    results, batches = str(tmp_path / "results"), str(tmp_path / "batches")
    o = observations(spark).withColumnsRenamed({"cas_number_1": "m1", "cas_number_2": "m2"})
    o = o.withColumn("m2", F.when(F.col("m2") == NAMES[11], "water").otherwise(F.col("m2")))
    write_block_folders(o, results)
    jobs.parse_job(spark, results, batches, 50, ids="folder")
    assert scan_csv_batches(spark, f"{batches}/*.csv", BATCH_SCHEMA).count() == o.count()
    dim = spark.createDataFrame([(n, f"name{k}", f"C{k}") for k, n in enumerate(NAMES[1:11], 1)] + [(None, "water", "O")], "cas_number string, solvent_name string, smiles string")
    rows = jobs.dataset_job(spark, f"{batches}/*.csv", dim).collect()
    assert len(rows) == 3 * 55  # entity 0 is in no dimension
    assert {r["smiles_2"] for r in rows if r["cas_number_2"] == "water"} == {"O"}
    assert all(abs(r["x1"] + r["x2"] - 1) < 1e-9 and r["temperature_k"] == 300.0 for r in rows)


def test_no_group_in_range_leaves_empty_tables(spark, tmp_path):
    """Every group goes: the stages with a folder per split have rows of no split, and still their columns."""
    path = str(tmp_path / "job")
    out = observations(spark).withColumn("ln_gamma_1", F.lit(9.0))
    done = split_job(spark, path, obs=out)
    assert done.made == STAGES and done["limited"].count() == 0
    assert done["data"].join(done["features"], ["split", "row_id"]).count() == 0
    assert set(done["data"].columns) == {"split", "row_id", "smiles_1", "smiles_2", "ln_gamma_1", "ln_gamma_2"}
    assert split_job(spark, path, obs=out).made == []
