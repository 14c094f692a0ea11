"""Joins, aggregates, histograms and set operations on hand-made tables."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.operators import aggregates as d
from pairflow.operators import histograms as h
from pairflow.operators import joins as j
from pairflow.operators import select as s
from pairflow.operators import sets as g
from pairflow.operators.sizing import measured

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_enrich_takes_first_candidate_and_no_null_match(spark):
    df = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old"), ("c", None)], "name string, smiles string")
    dim = spark.createDataFrame([("a", "z"), ("a", "y"), (None, "x"), ("c", "w")], "name string, smiles string")
    assert rows(j.enrich_left(df, dim, "name", "smiles"), "name") == [(None, None), ("a", "y"), ("b", None), ("c", "w")]
    assert rows(j.enrich_coalesce(df, dim, "name", "smiles"), "name") == [(None, "old"), ("a", "y"), ("b", "old"), ("c", "w")]


def test_fallback_by_name_is_keyed(spark):
    df = spark.createDataFrame([(1, "64-17-5"), (2, "water"), (3, "nothing"), (4, "1234567-89-0")], "i int, cas_number_1 string")
    dim = spark.createDataFrame(
        [("64-17-5", "ethanol", "CCO"), ("7732-18-5", "water", "O"), ("1234567-89-0", "long", "N")], "cas_number string, name string, smiles string"
    )
    out = j.resolve_with_fallback(df, dim, "cas_number_1", "cas_number", "name", "smiles", "smiles_1")
    # A seven-digit number counts as a name; not found as one, it keeps its key's value.
    assert rows(out.select("i", "smiles_1"), "i") == [(1, "CCO"), (2, "O"), (3, None), (4, "N")]


def test_first_candidate_by_the_order_of_the_dimension(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "a")], "k_1 string, k_2 string")
    dim = spark.createDataFrame(
        [("a", "z", 1), ("a", "y", 2), ("b", "q", 5), ("b", "p", 5), ("c", None, 1), ("c", "w", 2)], "k string, v string, seq int"
    )
    one = j.enrich_left(df.withColumnRenamed("k_1", "k"), dim, "k", "v", order=["seq"])
    assert rows(one.select("k", "v"), "k") == [("a", "z"), ("c", "w")]
    both = j.resolve_pair(df, dim, "k", "v", "k", "v", order=["seq"])
    assert rows(both.select("v_1", "v_2"), "v_1") == [("w", "z"), ("z", "p")]
    assert j.enrich_left(df.withColumnRenamed("k_1", "k"), dim, "k", "v").filter("k = 'a'").first()["v"] == "y"


def test_fallback_on_both_sides(spark):
    df = spark.createDataFrame([("64-17-5", "water"), ("water", "nothing"), (None, "water")], "c_1 string, c_2 string")
    dim = spark.createDataFrame([("64-17-5", "ethanol", "CCO"), ("7732-18-5", "water", "O")], "cas string, name string, smiles string")
    out = j.resolve_pair_with_fallback(df, dim, "c", "smiles", "cas", "name", "smiles")
    assert rows(out.select("smiles_1", "smiles_2")) == [("CCO", "O")]


def test_a_measured_side_leaves_the_facts_in_place(spark, plan, tmp_path):
    spark.range(5000).selectExpr("id % 7 AS k", "id * 0.1 AS x").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    side = measured(facts.groupBy("k").agg(F.avg("x").alias("m")).filter("k < 5"))
    for joined in (j.join_inner_keys(facts, side, ["k"]), j.join_left_keys(facts, side, ["k"]), j.join_many_to_many(facts, side, ["k"])):
        text = plan(joined)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_lookup_type_must_be_known(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError, match="Unknown lookup type"):
        j.lookup_by_type(df, df, "id", "INCHI", {"CAS": "id"}, "code")


def test_pair_resolution_drops_unresolved_sides(spark):
    df = spark.createDataFrame([("a", "b", "stale"), ("a", "x", "stale")], "k_1 string, k_2 string, v_1 string")
    dim = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "k string, v string, extra int")
    assert rows(j.resolve_pair(df, dim, "k", "v", "k", "v").select("v_1", "v_2")) == [("A", "B")]
    assert j.resolve_pair(df, dim, "k", "v", "k", "v", drop_unresolved=False).count() == 2


def test_float_keys_match_after_rounding(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 0.3, 7.0)], "k int, x double, y double")
    assert rows(j.join_left_keys(a, b, ["k", "x"], ["x"]).select("y", "y_pred")) == [(5.0, 7.0)]
    assert rows(j.join_many_to_many(a, b.withColumn("x", F.lit(0.4)), ["k", "x"], ["x"])) == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
@pytest.mark.parametrize("block", [1, 3, 256])
def test_all_pairs_are_complete_and_lexicographic(spark, n, block):
    df = spark.createDataFrame([(k,) for k in reversed(range(n))], "id int")
    got = rows(j.all_pairs(df, ["id"], ["id"], block=block), "pair_index")
    want = [(k, a, b, a, b) for k, (a, b) in enumerate(itertools.combinations(range(n), 2))]
    assert got == want


def test_all_pairs_is_an_equi_join(spark, plan):
    text = plan(j.all_pairs(spark.range(50), ["id"], ["id"]))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_pairs_within_and_across(spark):
    df = spark.createDataFrame(list(itertools.product("abc", repeat=2)), "m1 string, m2 string")
    a = spark.createDataFrame([("a",), ("a",)], "id string")
    b = spark.createDataFrame([("b",)], "id string")
    assert rows(j.pairs_within(df, a, "id")) == [("a", "a")]
    assert rows(j.pairs_across(df, a, b, "id"), "m1") == [("a", "b"), ("b", "a")]


def test_zip_and_complement(spark):
    a = spark.createDataFrame([("r1", 1), ("r2", 2)], "row_id string, y int")
    b = spark.createDataFrame([("r2", 20, 0), ("r1", 10, 0)], "row_id string, p int, y int")
    assert rows(j.zip_by_row(a, b), "row_id") == [("r1", 1, 10), ("r2", 2, 20)]
    assert rows(g.complement(a, a.filter("y = 1"))) == [("r2", 2)]


GROUPS = [
    ("keep", 0.0, 0.5), ("keep", -1.0, 0.9), ("null", 0.0, None), ("null", 0.0, 0.1), ("nan", 0.0, NAN),
    ("max", 0.0, 1.0), ("min", -1.0, -1.0), (None, 0.0, 0.0),
]


def test_limit_groups_keeps_or_drops_whole_groups(spark):
    df = spark.createDataFrame(GROUPS, "k string, a double, b double")
    kept = d.limit_groups(df, ["k"], {"a": (-1.0, 1.0), "b": (-1.0, 1.0)})
    assert rows(kept.groupBy("k").count(), "k") == [("keep", 2), ("min", 1)]
    assert d.limit_groups(df, ["k"], {"a": (5.0, 6.0)}).collect() == []


def test_scores_traps(spark):
    df = spark.createDataFrame(
        [("trap", y, 2 * y) for y in (1.0, 2.0, 3.0)] + [("perfect", 4.0, 4.0)] * 2 + [("constant", 4.0, p) for p in (4.0, 5.0)],
        "model string, y double, y_pred double",
    )
    got = {r["model"]: r for r in d.regression_scores(df, ["y"], ["model"]).collect()}
    assert got["trap"]["y_r2"] == pytest.approx(-6.0)
    assert got["trap"]["y_mae"] == pytest.approx(2.0)
    assert got["trap"]["y_rmse"] == pytest.approx((14 / 3) ** 0.5)
    assert got["perfect"]["y_r2"] == 1.0
    assert got["constant"]["y_r2"] == 0.0


def test_group_sizes_report_what_is_skipped(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 3 + [(None,)], "k string")
    assert rows(d.group_sizes(df, ["k"]), "k") == [("a", 4, False), ("b", 3, True)]
    assert rows(d.min_group_size(df, ["k"]).distinct()) == [("a",)]


def test_dedup_treats_null_as_equal(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, i int")
    assert rows(d.dedup_subset(df, ["k"], ["i"]), "i") == [(None, 1), ("a", 3)]


def test_first_per_key_limits_on_the_map_side(spark, plan):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    assert plan(d.dedup_subset(df, ["k"], ["v"])).count("WindowGroupLimit") == 2


def test_profile_counts_null_and_drops_wide_columns(spark):
    df = spark.range(500).select(
        (F.col("id") % 9).alias("nine"), (F.col("id") % 10).alias("ten"), "id",
        F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("nine_null"), F.lit(None).cast("string").alias("empty"),
    )
    counts = dict(rows(d.low_cardinality_profile(df).groupBy("column").count()))
    assert counts == {"nine": 9, "nine_null": 9, "empty": 1}


@pytest.mark.parametrize("values", [[0.0, 1.0, 2.0, 10.0], [3.0, 3.0], list(np.linspace(-1, 1, 57)), [0.1, 0.2, 0.3, 0.7]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (NAN,)], "v double")
    if len(set(values)) == 1:
        assert sum(r["n"] for r in h.histogram(df, "v", 10).collect()) == len(values)
        return
    got = [r["n"] for r in h.histogram(df, "v", 10).orderBy("bin").collect()]
    assert got == np.histogram(values, 10)[0].tolist()


def test_histogram_edges_close_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (-60, 0, 60, 61, -61)], "v double")
    got = [r["n"] for r in h.histogram_edges(df, "v").orderBy("bin").collect()]
    assert got == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1]


def test_histogram_2d_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    want = np.histogram2d(x, y, (6, 4))[0]
    got = np.zeros((6, 4))
    for r in h.histogram_2d(df, "x", "y", (6, 4)).collect():
        got[r["bin_x"], r["bin_y"]] = r["n"]
    assert (got == want).all()


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 5)] + [("b", 1.0)], "k string, v double")
    got = h.kde(df, "v", ["k"], -20, 25, 901).filter("k = 'a'").agg(F.sum("density") * 0.05).first()[0]
    assert got == pytest.approx(1.0, abs=1e-6)


def test_value_counts_and_fraction(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert rows(d.value_counts(df, "v")) == [("b", 2), ("a", 1)]
    assert d.fraction_where(df, F.col("v") == "b").first()[0] == 0.5


def test_empty_range_check_and_union(spark):
    empty = spark.createDataFrame([], "v double")
    assert d.all_in_range(empty, ["v"], 0, 1).first()[0] is True
    both = g.union_tagged({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2,)], "y int")})
    assert sorted(both.columns) == ["split", "x", "y"] and both.count() == 2


def test_filters_reach_the_scan(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(path)
    text = plan(s.filter_abs_below(spark.read.parquet(path), "id", 5).filter("b > 3").select("id"))
    assert "GreaterThan(b,3)" in text and "c:string" not in text


def test_null_candidates_never_win(spark):
    dim = spark.createDataFrame([("k", None), ("k", "b"), ("k", "a"), ("n", None)], "key string, value string")
    rows = spark.createDataFrame([("k",), ("n",), ("x",)], "key string")
    found = {r["key"]: r["value"] for r in j.enrich_left(rows, dim, "key", "value").collect()}
    assert found == {"k": "a", "n": None, "x": None}


def test_scores_use_rows_with_both_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (30.0, None), (40.0, float("nan"))], "y double, y_pred double")
    r = d.regression_scores(df, ["y"]).first()
    assert r["y_r2"] == pytest.approx(0.5) and r["y_mae"] == pytest.approx(0.25)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_a_restart_gives_the_same_pairs(spark, n):
    df = spark.range(n).repartition(3)
    whole = rows(j.all_pairs(df, ["id"], ["id"], block=3), "pair_index")
    total = n * (n - 1) // 2
    for start, stop in [(0, None), (total - 1, None), (total // 3, total // 2), (total, None), (3, 3), (-2, 10**9)]:
        got = rows(j.all_pairs(df, ["id"], ["id"], block=3, start=start, stop=stop), "pair_index")
        assert got == [r for r in whole if r[0] >= start and (stop is None or r[0] < stop)]
    assert all(j.unrank_pair(r[0], n) == (r[1], r[2]) for r in whole)


def test_unranking_is_exact_for_large_indices():
    n = 3_000_000_001
    for k in (0, n - 2, n - 1, n * (n - 1) // 2 - 1, n * (n - 1) // 4, 10**18 + 7):
        a, b = j.unrank_pair(k, n)
        assert 0 <= a < b < n and a * (2 * n - a - 1) // 2 + b - a - 1 == k


def test_a_late_restart_joins_few_pairs(spark):
    """At 99 %, the join is of the last tenth of the entities with itself: 1 % of the pairs."""
    n = 600
    total = n * (n - 1) // 2
    start = int(0.99 * total)
    assert j.unrank_pair(start, n)[0] >= 0.89 * n
    pairs = j.all_pairs(spark.range(n), ["id"], ["id"], block=16, start=start)
    assert pairs.count() == total - start
    bounds = re.findall(r"\+ __pos#\d+L\) >=? (\d+)", pairs._jdf.queryExecution().optimizedPlan().toString())
    assert len(bounds) >= 2 and all(int(b) >= 0.89 * n for b in bounds)


@pytest.mark.parametrize("n, fits", [(0, True), (1, True), (2, True), (50, True), (50, False)])
def test_pairs_of_broadcast_blocks_and_of_shuffled_ones(spark, plan, monkeypatch, n, fits):
    if not fits:
        monkeypatch.setattr(j, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(k, f"e{k}" if k % 7 else None) for k in range(n)], "id long, name string").repartition(3)
    for start, stop in [(0, None), (100, 1100)]:
        pairs = j.all_pairs(df, ["id"], ["id", "name"], block=4, start=start, stop=stop)
        want = [(k, a, b, a, f"e{a}" if a % 7 else None, b, f"e{b}" if b % 7 else None) for k, (a, b) in enumerate(itertools.combinations(range(n), 2))]
        assert rows(pairs, "pair_index") == want[start:stop]


def test_pairs_of_broadcast_blocks_shuffle_no_copies(spark, plan):
    """Only the entities are shuffled, never a copy for each block that they meet."""
    text = plan(j.all_pairs(spark.range(300), ["id"], ["id"], block=8))
    assert "REPARTITION_BY_NUM" not in text and text.count("BroadcastHashJoin") >= 2
