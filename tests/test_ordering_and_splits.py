"""Row numbering, exact sampling, cluster walks and pair splits."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairflow.operators import ordering as e
from pairflow.operators import splits as sp
from pairflow.plans.jobs import condition_grid, generate_job

ROLE = {"t1": "train", "t2": "train", "v": "valid", "s": "test"}


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_row_index_is_dense_whatever_the_partitioning(spark, parts):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v % 3, v) for v in values], "k int, v int").repartition(parts)
    got = rows(e.row_index(df, ["k", "v"]).select("k", "v", "row_index"), "row_index")
    assert got == [(k, v, i) for i, (k, v) in enumerate(sorted((v % 3, v) for v in values))]


def test_row_index_has_no_window_over_the_rows(spark, plan):
    text = plan(e.row_index(spark.range(1000), ["id"]))
    # The one window numbers partitions; the rows only get their offset.
    assert "Window " not in text and "Scan ExistingRDD" in text


def test_batches_are_full_but_the_last(spark):
    df = e.batch_id(e.row_index(spark.range(25), ["id"]), 10)
    assert rows(df.groupBy("batch_id").count(), "batch_id") == [(0, 10), (1, 10), (2, 5)]


@pytest.mark.parametrize("n", [1, 2, 99, 100, 1000])
@pytest.mark.parametrize("fraction", [0.01, 0.5, 0.0, 1.0])
def test_holdout_is_exact(spark, n, fraction):
    df = spark.range(n).select(F.col("id").cast("string").alias("row_id"))
    got = {r["row_id"] for r in e.holdout_fraction(df, fraction, 5).filter("part = 'train'").collect()}
    ranked = sorted((hashlib.md5(f"5:{k}".encode()).hexdigest(), str(k)) for k in range(n))
    assert got == {k for _, k in ranked[: int((1.0 - fraction) * n)]}


def test_random_split_is_stable(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("row_id"))
    weights = {"train": 0.8, "valid": 0.1, "test": 0.1}
    a = rows(e.random_split(df, weights, 1), "row_id")
    b = rows(e.random_split(df.repartition(13), weights, 1), "row_id")
    assert a == b
    assert abs(sum(part == "train" for _, part in a) / 2000 - 0.8) < 0.05


def walk(sizes, valid, test):
    """Plain statement of the cluster walk."""
    n, train = sum(sizes), 1.0 - test - valid
    n_train = n_valid = 0
    out = []
    for c in sizes:
        if n_train + c <= train * n:
            out.append("train")
            n_train += c
        elif n_train + n_valid + c <= (train + valid) * n:
            out.append("valid")
            n_valid += c
        else:
            out.append("test")
    return out


def roles_of(df):
    return [r[1] for r in rows(df.select("cluster", "role").distinct(), "cluster")]


def entities(spark, sizes):
    return spark.createDataFrame([(f"{k}-{i}", k) for k, c in enumerate(sizes) for i in range(c)], "id string, cluster int")


def test_small_cluster_may_enter_train_late(spark):
    got = sp.greedy_cluster_split(entities(spark, [50, 40, 8]), valid_size=0.05, test_size=0.15)
    assert roles_of(got) == ["train", "test", "train"]


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_walk_is_the_same_in_chunks(spark, chunk):
    sizes = [random.Random(k).randint(1, 9) for k in range(13)]
    got = sp.greedy_cluster_split(entities(spark, sizes), valid_size=0.2, test_size=0.2, chunk=chunk)
    assert roles_of(got) == walk(sizes, 0.2, 0.2)


def pairs(spark, copies=1):
    data = [(f"{a}{b}{c}", a, b) for a, b in itertools.product([*ROLE, "unknown"], repeat=2) for c in range(copies)]
    return spark.createDataFrame(data, "row_id string, m1 string, m2 string")


def members(spark):
    return spark.createDataFrame(list(ROLE.items()), "id string, role string")


def expected_split(a, b):
    r = {ROLE.get(a), ROLE.get(b)}
    names = {
        frozenset({"train", "valid"}): "valid_mix", frozenset({"train", "test"}): "test_mix",
        frozenset({"valid"}): "valid_indp", frozenset({"test"}): "test_indp", frozenset({"train"}): "train",
    }
    return names.get(frozenset(r))


def test_all_roles_strict(spark):
    got = {r["row_id"]: r["split"] for r in sp.assign_pair_splits(pairs(spark), members(spark), "id", holdout=0.0).collect()}
    want = {f"{a}{b}0": expected_split(a, b) for a, b in itertools.product([*ROLE, "unknown"], repeat=2)}
    assert got == {k: v for k, v in want.items() if v}


def test_compat_takes_any_pair_with_a_valid_first(spark):
    got = rows(sp.assign_pair_splits(pairs(spark), members(spark), "id", holdout=0.0, strict=False).select("m1", "m2", "split"))
    assert {(a, b) for a, b, s in got if s == "valid_indp"} == {("v", x) for x in [*ROLE, "unknown"]}
    assert ("v", "t1", "valid_mix") in got and len(got) > len(set((a, b) for a, b, _ in got))


@pytest.mark.parametrize("holdout", [0.01, 0.3])
def test_no_leak_and_exact_holdout(spark, holdout):
    splits = sp.assign_pair_splits(pairs(spark, 30), members(spark), "id", holdout=holdout)
    counts = dict(rows(splits.groupBy("split").count()))
    n = 4 * 30
    assert counts["train"] == int((1.0 - holdout) * n) and counts["train"] + counts["valid_cont"] == n
    assert splits.select("row_id").distinct().count() == splits.count()
    seen = splits.filter("split = 'train'").filter("m1 IN ('v', 's') OR m2 IN ('v', 's')")
    assert seen.count() == 0


def test_grid_has_no_drift(spark):
    df = spark.createDataFrame([("p", 300.0, 340.0)], "p string, t_min double, t_max double")
    got = condition_grid(df).collect()
    assert len(got) == 55
    assert sorted({r["x1"] for r in got}) == [k / 10 for k in range(11)]
    assert sorted({r["temperature_k"] for r in got}) == [300.0, 310.0, 320.0, 330.0, 340.0]


def test_generation_resumes(spark):
    df = spark.createDataFrame([(k, 300.0 + k) for k in range(6)], "id int, bp double")
    whole = generate_job(df, "id", "bp", batch_size=4)
    rest = generate_job(df, "id", "bp", batch_size=4, start=8)
    assert whole.select("pair_index").distinct().count() == 15
    assert rest.count() == 7 * 55
    assert rows(whole.select("batch_id").distinct(), "batch_id") == [(0,), (1,), (2,), (3,)]
    assert whole.filter("temperature_k < t_min OR temperature_k > t_max").count() == 0


def test_kelvin(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 20.0)], "id int, bp double")
    assert generate_job(df, "id", "bp", units="C").agg(F.min("temperature_k")).first()[0] == pytest.approx(283.15)


def walk_of(sizes, train_cut, valid_cut):
    train = valid = 0
    for s in sizes:
        if train + s <= train_cut:
            train += s
            yield "train"
        elif train + valid + s <= valid_cut:
            valid += s
            yield "valid"
        else:
            yield "test"


@pytest.mark.parametrize("draw", [lambda r: r.choice([1, 2, 3, 20, 50]), lambda r: int(r.paretovariate(0.7)), lambda r: r.randint(1, 30)])
def test_walk_in_passes_is_the_walk_in_order(spark, draw, monkeypatch):
    monkeypatch.setattr(sp, "SPAN", 7)
    rng = random.Random(9)
    sizes = [draw(rng) for _ in range(60)]
    train_cut, valid_cut = int(0.8 * sum(sizes)), int(0.87 * sum(sizes))
    numbered = spark.createDataFrame(list(enumerate(sizes)), "place long, size long")
    known = numbered.withColumn("train", sp.accepted(numbered, train_cut))
    role = F.when(F.col("train"), "train").when(sp.accepted(known, valid_cut, F.col("train")), "valid").otherwise("test")
    got = known.select("place", role.alias("role")).orderBy("place").collect()
    assert [r.role for r in got] == list(walk_of(sizes, train_cut, valid_cut))


def test_jobs_of_the_walk_do_not_grow_with_the_clusters(spark):
    entities = spark.range(100_000).select("id", F.col("id").alias("cluster"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "")
    got = {r.role: r["count"] for r in sp.greedy_cluster_split(entities).groupBy("role").count().collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"train": 80_000, "valid": 5_000, "test": 15_000}
    assert len(tracker.getJobIdsForGroup("walk")) < 60
