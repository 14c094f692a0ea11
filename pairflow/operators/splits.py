"""Leakage-aware splits of entities and of pairs (E3, E8)."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairflow.functions.scalars import any_of, is_true, seeded_hash
from pairflow.operators.ordering import fraction_threshold, row_index
from pairflow.operators.sizing import measured
from pairflow.schema import ENTITY_COLUMNS, ROW_ID
from pairflow.session import ensure_checkpoint_dir

# Clusters walked within one array; longer lists are walked in passes over spans of places.
FOLD_CHUNK, SPAN = 2000, 1 << 16


def _walk(clusters: Column, n_train: Column, n_valid: Column, train_cut: Column, valid_cut: Column) -> Column:
    """Struct of the final sizes and the (cluster, role) list after walking an array."""

    def decision(c: Column, role: Column) -> Column:
        return F.struct(c["cluster"].alias("cluster"), role.alias("role"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["n_train"] + c["size"]) > train_cut
        over = (acc["n_train"] + acc["n_valid"] + c["size"]) > valid_cut
        role = F.when(~full, F.lit("train")).when(over, F.lit("test")).otherwise(F.lit("valid"))
        return F.struct(
            (acc["n_train"] + F.when(role == "train", c["size"]).otherwise(F.lit(0))).alias("n_train"),
            (acc["n_valid"] + F.when(role == "valid", c["size"]).otherwise(F.lit(0))).alias("n_valid"),
            F.concat(acc["roles"], F.array(decision(c, role))).alias("roles"),
        )

    nothing = F.transform(F.slice(clusters, 1, 0), lambda c: decision(c, F.lit("train").substr(1, 9)))
    start = F.struct(
        n_train.cast("long").alias("n_train"), n_valid.cast("long").alias("n_valid"), nothing.alias("roles")
    )
    return F.aggregate(clusters, start, step)


def greedy_cluster_split(
    entities: DataFrame,
    cluster: str = "cluster",
    valid_size: float = 0.05,
    test_size: float = 0.15,
    name: str = "role",
    chunk: int = FOLD_CHUNK,
) -> DataFrame:
    """Assign whole clusters to train, valid or test, walking them in label order.

    A cluster goes to train if it still fits, else to valid if it fits, else to
    test; a later small cluster may still enter train.  Entities without a cluster stay,
    with a NULL role.  Only cluster sizes are walked, checkpointed once.  Up to
    ``chunk`` of them are walked in one array; more are walked by ``accepted``, in passes
    whose number grows with the logarithm of the room, not with the clusters.
    """
    spark = entities.sparkSession
    ensure_checkpoint_dir(spark)
    train_size = 1.0 - test_size - valid_size
    sizes = (
        entities.filter(F.col(cluster).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("size"))
        .checkpoint()
    )
    n_clusters, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    train_cut, valid_cut = train_size * total, (train_size + valid_size) * total
    if n_clusters <= chunk:
        listed = sizes.agg(F.sort_array(F.collect_list(F.struct("cluster", "size"))).alias("clusters"))
        zero = F.lit(0)
        walk = _walk(F.col("clusters"), zero, zero, F.lit(train_cut), F.lit(valid_cut))
        roles = listed.select(walk.alias("walk")).select(F.inline("walk.roles"))
    else:
        numbered = row_index(sizes, ["cluster"], "place").checkpoint()
        in_train = accepted(numbered, floor(train_cut))
        known = numbered.withColumn("train", in_train)
        in_valid = accepted(known, floor(valid_cut), F.col("train"))
        role = F.when(F.col("train"), "train").when(in_valid, "valid").otherwise("test")
        roles = known.select("cluster", role.alias("role"))
    return entities.join(roles.select(F.col("cluster").alias(cluster), F.col("role").alias(name)), cluster, "left")


def accepted(numbered: DataFrame, room: int, forced: Column | None = None) -> Column:
    """Which of the clusters (place, size) a walk in order takes while they fit into ``room``.

    ``forced`` ones use up room in any case and are not asked.  In each pass no cluster above
    a mark can be taken but the last of the pass, and all up to the mark are: as long as the
    room stays above the mark, they fit.  The mark is the largest size that fits, or else half
    the room, so a pass that ends halves the room at least.  A pass needs sums of sizes only:
    over spans of places, then within spans.  The result is a chain of as many conditions as
    there were passes.
    """
    taken = F.lit(False)
    forced = F.lit(False) if forced is None else forced
    rows = numbered.select("place", "size", forced.alias("forced"), F.floor(F.col("place") / SPAN).alias("span"))
    start = 0
    while room > 0:
        ahead = rows.filter(F.col("place") >= start)
        asked = ~F.col("forced")
        largest = ahead.agg(F.max(F.when(asked & (F.col("size") <= room), F.col("size")))).first()[0]
        if largest is None:
            break
        mark = largest if 2 * largest <= room else room // 2
        sure = F.col("forced") | (F.col("size") <= mark)
        used = ahead.withColumn("used", F.when(sure, F.col("size")).otherwise(F.lit(0)))
        spans = used.groupBy("span").agg(F.sum("used").alias("in_span"))
        before = spans.select("span", (F.sum("in_span").over(Window.orderBy("span")) - F.col("in_span")).alias("before"))
        upto = F.sum("used").over(Window.partitionBy("span").orderBy("place"))
        summed = used.withColumn("upto", upto).join(F.broadcast(before), "span").withColumn("upto", F.col("upto") + F.col("before"))
        fits = asked & (F.col("size") > mark) & (F.col("upto") + F.col("size") <= room)
        low = sure & (room - F.col("upto") <= mark)
        end = summed.filter(fits | low).agg(F.min(F.struct("place", F.when(fits, F.col("upto") + F.col("size")).otherwise(F.col("upto")).alias("upto"))).alias("e")).first()["e"]
        within = F.col("place") >= start
        if end is None:
            return taken | (within & ~forced & (F.col("size") <= mark))
        last = end["place"]
        taken = taken | (within & (F.col("place") <= last) & ~forced & ((F.col("size") <= mark) | ((F.col("place") == last) & (F.col("size") <= room))))
        start, room = last + 1, room - end["upto"]
    return taken


def with_roles(
    obs: DataFrame, entities: DataFrame, key: str, role: str = "role", columns: list[str] = ENTITY_COLUMNS
) -> DataFrame:
    """Attach the role of both endpoints as ``role_1`` and ``role_2``."""
    entities = measured(entities.select(key, role))
    for i, c in enumerate(columns, start=1):
        obs = obs.join(entities.select(F.col(key).alias(c), F.col(role).alias(f"role_{i}")), c, "left")
    return obs


def assign_pair_splits(
    obs: DataFrame,
    entities: DataFrame,
    key: str,
    holdout: float = 0.01,
    seed: int = 1995,
    strict: bool = True,
    role: str = "role",
    columns: list[str] = ENTITY_COLUMNS,
    row_id: str = ROW_ID,
    name: str = "split",
) -> DataFrame:
    """Split label of every observation from the roles of its two entities.

    Both train: train, less an exact fraction of rows for valid_cont.  One train and
    one valid (test): valid_mix (test_mix).  Both valid (test): valid_indp
    (test_indp).  Other pairs belong to no split and are dropped.

    ``strict=False`` takes every pair whose first entity is valid into valid_indp,
    so that such a row may come out twice.
    """
    labelled = with_roles(obs, entities, key, role, columns)
    one, two = F.col("role_1"), F.col("role_2")

    def both(r: str) -> Column:
        return is_true((one == r) & (two == r))

    def mixed(a: str, b: str) -> Column:
        return is_true(((one == a) & (two == b)) | ((one == b) & (two == a)))

    threshold = fraction_threshold(labelled.filter(both("train")), 1.0 - holdout, seed, row_id)
    kept = F.coalesce(seeded_hash(row_id, seed) <= threshold, F.lit(False))
    independent = both("valid") if strict else is_true(one == "valid")
    # Membership first: it needs no hash, so rows of no split are dropped for nothing.
    members = {
        "train": both("train"),
        "valid_mix": mixed("train", "valid"),
        "valid_indp": independent,
        "test_mix": mixed("train", "test"),
        "test_indp": both("test"),
    }
    names = {s: F.lit(s) for s in members} | {"train": F.when(kept, "train").otherwise("valid_cont")}
    placed = labelled.filter(any_of(list(members.values())))
    labels = [F.when(inside, names[s]) for s, inside in members.items()]
    label = F.coalesce(*labels) if strict else F.explode(F.array_compact(F.array(*labels)))
    return placed.withColumn(name, label).drop("role_1", "role_2")
