"""Broadcast only what was measured to be small."""

from pyspark.sql import functions as F

from pairflow.operators.aggregates import limit_groups
from pairflow.operators.sizing import measured


def joined(spark, limit):
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    sums = facts.groupBy("k").agg(F.sum("v").alias("s"), F.max(F.col("v").cast("string")).alias("t"))
    return facts.join(measured(sums, limit), "k")


def test_small_sides_are_broadcast_and_large_ones_are_not(spark, plan):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = joined(spark, 1 << 20), joined(spark, 10)
        assert "BroadcastHashJoin" in plan(small)
        assert "BroadcastHashJoin" not in plan(large)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_group_limit_does_not_shuffle_the_rows(spark, plan):
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    text = plan(limit_groups(facts, ["k"], {"v": (0.0, 996.0)}))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
