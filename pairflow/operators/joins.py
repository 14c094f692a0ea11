"""Joins (section 2.3).

A plain table is broadcast by the optimizer when its known size is under
``spark.sql.autoBroadcastJoinThreshold``.  A side that is itself an aggregate is
measured first (``sizing.measured``).  Everything else is sort-merged, and adaptive
execution splits skewed partitions.

Lookups of a dimension take the first candidate of a key: by the dimension's columns named in
``order``, of ties (or without an order) the smallest value.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions.scalars import is_registry_id
from pairflow.operators.ordering import first_per_key, row_index
from pairflow.operators.select import drop_if_exists, drop_incomplete
from pairflow.operators.sizing import BROADCAST_BYTES, measured, rows_and_bytes
from pairflow.schema import ENTITY_COLUMNS, GROUP_KEYS, ROW_ID


def _lookup(dim: DataFrame, key: str, value: str, key_as: str, value_as: str, order: list[str] = ()) -> DataFrame:
    """Dimension cut down to one (key, value) row per known key: of several values the first; NULL is none."""
    places = {f"__order_{i}": c for i, c in enumerate(order)}
    pruned = dim.select(F.col(key).alias(key_as), F.col(value).alias(value_as), *[F.col(c).alias(n) for n, c in places.items()])
    known = pruned.filter(F.col(key_as).isNotNull() & F.col(value_as).isNotNull())
    return first_per_key(known, [key_as], [*places, value_as]).select(key_as, value_as)


def enrich_left(
    df: DataFrame, dim: DataFrame, on: str, value: str, dim_key: str | None = None, order: list[str] = ()
) -> DataFrame:
    """Left join one resolved value; the first candidate per key counts."""
    found = _lookup(dim, dim_key or on, value, on, value, order)
    return drop_if_exists(df, [value]).join(found, on, "left")


def enrich_coalesce(
    df: DataFrame, dim: DataFrame, on: str, value: str, dim_key: str | None = None, order: list[str] = ()
) -> DataFrame:
    """As ``enrich_left``, but an existing value fills the gaps of the new one."""
    found = _lookup(dim, dim_key or on, value, on, "__new", order)
    joined = df.join(found, on, "left")
    return joined.withColumn(value, F.coalesce("__new", value)).drop("__new")


def resolve_pair(
    df: DataFrame,
    dim: DataFrame,
    key_prefix: str,
    value_prefix: str,
    dim_key: str,
    dim_value: str,
    drop_unresolved: bool = True,
    order: list[str] = (),
) -> DataFrame:
    """Resolve both entity columns against one dimension."""
    out = drop_if_exists(df, [f"{value_prefix}_{i}" for i in (1, 2)])
    for i in (1, 2):
        key, value = f"{key_prefix}_{i}", f"{value_prefix}_{i}"
        out = out.join(_lookup(dim, dim_key, dim_value, key, value, order), key, "left")
    return drop_incomplete(out, [f"{value_prefix}_{i}" for i in (1, 2)]) if drop_unresolved else out


def resolve_with_fallback(
    df: DataFrame, dim: DataFrame, key: str, dim_key: str, alt_key: str, dim_value: str, value: str, order: list[str] = ()
) -> DataFrame:
    """Resolve by key; keys that are not registry-shaped are names and go by name.

    A name that is not found keeps what the key lookup gave.
    """
    by_key = _lookup(dim, dim_key, dim_value, key, "__by_key", order)
    by_name = _lookup(dim, alt_key, dim_value, key, "__by_name", order)
    joined = drop_if_exists(df, [value]).join(by_key, key, "left").join(by_name, key, "left")
    resolved = F.when(is_registry_id(key), F.col("__by_key")).otherwise(F.coalesce("__by_name", "__by_key"))
    return joined.withColumn(value, resolved).drop("__by_key", "__by_name")


def resolve_pair_with_fallback(
    df: DataFrame,
    dim: DataFrame,
    key_prefix: str,
    value_prefix: str,
    dim_key: str,
    alt_key: str,
    dim_value: str,
    order: list[str] = (),
) -> DataFrame:
    """Both sides of a pair by key, names by name; unresolved rows are dropped."""
    out = df
    for i in (1, 2):
        out = resolve_with_fallback(
            out, dim, f"{key_prefix}_{i}", dim_key, alt_key, dim_value, f"{value_prefix}_{i}", order
        )
    return drop_incomplete(out, [f"{value_prefix}_{i}" for i in (1, 2)])


def lookup_by_type(
    df: DataFrame, dim: DataFrame, id_column: str, id_type: str, columns: dict[str, str], value: str, order: list[str] = ()
) -> DataFrame:
    """Look up by the dimension column that holds the given identifier type."""
    if id_type not in columns:
        raise ValueError(f"Unknown lookup type: {id_type}.")
    return enrich_left(df, dim, id_column, value, dim_key=columns[id_type], order=order)


def unresolved(df: DataFrame, dim: DataFrame, on: str, dim_key: str | None = None) -> DataFrame:
    """Reject table: rows whose key the dimension lacks."""
    keys = dim.select(F.col(dim_key or on).alias(on))
    return df.join(keys, on, "left_anti")


def join_inner_keys(a: DataFrame, b: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Rows of both sides with equal keys.  Pass a ``b`` that is an aggregate through ``measured``: the optimizer takes it for large."""
    return a.join(b, keys, "inner")


def _fixed_point(c: Column, places: int) -> Column:
    return F.round(c * F.lit(10.0**places)).cast("long")


def join_left_keys(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    float_keys: list[str] = (),
    suffix: str = "_pred",
    places: int = 6,
) -> DataFrame:
    """Left join; the right side's other columns get the suffix.

    Floating keys are matched after rounding to ``places`` decimals.
    """
    exact = [k for k in keys if k not in float_keys]
    matchers = {k: f"__match_{i}" for i, k in enumerate(float_keys)}
    left = a.withColumns({m: _fixed_point(F.col(k), places) for k, m in matchers.items()})
    right = b.select(
        *exact,
        *[_fixed_point(F.col(k), places).alias(m) for k, m in matchers.items()],
        *[F.col(c).alias(c + suffix) for c in b.columns if c not in keys],
    )
    return left.join(right, exact + list(matchers.values()), "left").drop(*matchers.values())


def join_many_to_many(
    a: DataFrame, b: DataFrame, keys: list[str], float_keys: list[str] = (), suffix: str = "_pred"
) -> DataFrame:
    """Join predictions to observations and keep complete rows.

    Give the composition as a key: without it every observation of a group meets
    every prediction of that group.
    """
    return drop_incomplete(join_left_keys(a, b, keys, float_keys, suffix))


def pairs_within(
    df: DataFrame, entities: DataFrame, key: str, columns: list[str] = ENTITY_COLUMNS
) -> DataFrame:
    """Rows with both endpoints in the set."""
    for c in columns:
        df = df.join(entities.select(F.col(key).alias(c)), c, "left_semi")
    return df


def pairs_across(
    df: DataFrame, a: DataFrame, b: DataFrame, key: str, columns: list[str] = ENTITY_COLUMNS
) -> DataFrame:
    """Rows with one endpoint in A and the other in B, in either order."""
    sides = (
        a.select(key, F.lit(True).alias("a"), F.lit(False).alias("b"))
        .union(b.select(key, F.lit(False), F.lit(True)))
        .groupBy(key)
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    sides = measured(sides)
    original = df.columns
    for i, c in enumerate(columns):
        side = sides.select(F.col(key).alias(c), F.col("a").alias(f"__a{i}"), F.col("b").alias(f"__b{i}"))
        df = df.join(side, c, "inner")
    across = (F.col("__a0") & F.col("__b1")) | (F.col("__b0") & F.col("__a1"))
    return df.filter(across).select(original)


# Pairs one task of ``all_pairs`` should put out, and the most tasks it may use.
PAIRS_PER_TASK, MOST_TASKS = 1_000_000, 10_000


def all_pairs(
    df: DataFrame,
    order: list[str],
    columns: list[str],
    suffixes: tuple[str, str] = ("_1", "_2"),
    block: int = 256,
    start: int = 0,
    stop: int | None = None,
) -> DataFrame:
    """All ``n choose 2`` pairs ``i < j`` with their lexicographic ``pair_index``.

    Of a restart, only indices from ``start`` on and below ``stop`` are built: both bounds are
    unranked to a pair, and entities that no pair between them has are left out of the join.

    Entities get a dense index and are cut into blocks of at most ``block``.  Entities that were
    measured to fit are broadcast, and a task builds the pairs of its share of the block pairs:
    nothing is shuffled.  Else every block pair is one join key of an evenly spread equi-join,
    of blocks as large as the number of tasks allows, which moves ``n*n/block`` entity rows.
    The tasks are set by the number of pairs, which the size of the input hides.
    """
    spark = df.sparkSession
    indexed = row_index(df.select(*dict.fromkeys([*order, *columns])), order, name="__i")
    n, size = rows_and_bytes(indexed.select("__i", *columns))
    all_ = n * (n - 1) // 2
    start, stop = max(start, 0), all_ if stop is None else min(stop, all_)
    wanted = max(stop - start, 0)
    first, last_i = (unrank_pair(k, n)[0] if wanted else n for k in (start, max(stop - 1, 0)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted // PAIRS_PER_TASK, MOST_TASKS))
    fits = size is not None and size <= BROADCAST_BYTES
    # At least some four block pairs per task, for balance.
    even = n // max(1, isqrt(8 * tasks))
    block = max(1, min(block, even) if fits else even)
    entities = indexed.select("__i", *columns, F.floor(F.col("__i") / F.lit(block)).cast("long").alias("__b"))
    left = entities.filter(F.col("__i").between(first, last_i))
    right = entities.filter(F.col("__i") > first)
    last = max(0, (n - 1) // block)
    made = _pairs_of_blocks if fits else _pairs_by_block_key
    pairs = made(left, right, columns, suffixes, (first // block, last_i // block, last) if wanted else None, tasks)
    i, j = F.col("i"), F.col("j")
    before = F.shiftright(i * (F.lit(2 * n) - i - 1), 1)
    indexed_pairs = pairs.filter(i < j).select(
        (before + (j - i - 1)).alias("pair_index"),
        "i",
        "j",
        *[c + s for s in suffixes for c in columns],
    )
    return indexed_pairs.filter((F.col("pair_index") >= start) & (F.col("pair_index") < stop))


def _pairs_of_blocks(left: DataFrame, right: DataFrame, columns: list[str], suffixes: tuple[str, str], blocks: tuple[int, int, int] | None, tasks: int) -> DataFrame:
    """Pairs of the block pairs from a first to a last one, whose numbers are dealt out as a range; blocks are broadcast."""
    low, high, last = blocks or (0, -1, 0)
    row = 2 * last + 3  # a row of block pairs starts at k * (row - k) / 2
    at = lambda k: k * (row - k) // 2
    begins = lambda k: F.shiftright(k * (F.lit(row) - k), 1)
    p, b = F.col("id"), F.col("__b1")
    near = F.floor((F.lit(float(row)) - F.sqrt(F.greatest(F.lit(float(row) ** 2) - p * 8.0, F.lit(0.0)))) / 2).cast("long")
    exact = F.when(begins(b) > p, b - 1).when(begins(b + 1) <= p, b + 1).otherwise(b)
    numbers = left.sparkSession.range(at(low), max(at(low), at(high + 1)), 1, tasks)
    dealt = numbers.withColumn("__b1", near).withColumn("__b1", exact).select("__b1", (p - begins(b) + b).alias("__b2"))

    def listed(side: DataFrame, k: int) -> DataFrame:
        members = F.collect_list(F.struct("__i", *columns)).alias(f"__side{k}")
        return F.broadcast(side.groupBy(F.col("__b").alias(f"__b{k}")).agg(members))

    met = dealt.join(listed(left, 1), "__b1").join(listed(right, 2), "__b2")
    one = met.select(F.explode("__side1").alias("__one"), "__side2")
    two = one.select("__one", F.explode("__side2").alias("__two"))
    sides = [("__one", "i", suffixes[0]), ("__two", "j", suffixes[1])]
    return two.select(*[c for side, name, s in sides for c in (F.col(f"{side}.__i").alias(name), *[F.col(side)[c].alias(c + s) for c in columns])])


def _pairs_by_block_key(left: DataFrame, right: DataFrame, columns: list[str], suffixes: tuple[str, str], blocks: tuple[int, int, int] | None, tasks: int) -> DataFrame:
    """The same by an equi-join on the block pair, to which both sides are shuffled."""
    low, high, last = (F.lit(k).cast("long") for k in blocks or (0, 0, 0))
    b, upto = F.col("__b"), F.least(F.col("__b"), high)
    one = left.select(
        F.col("__i").alias("i"),
        *[F.col(c).alias(c + suffixes[0]) for c in columns],
        b.alias("__b1"),
        F.explode(F.sequence(b, last)).alias("__b2"),
    )
    two = right.filter(low <= upto).select(
        F.col("__i").alias("j"),
        *[F.col(c).alias(c + suffixes[1]) for c in columns],
        b.alias("__b2"),
        F.explode(F.sequence(low, upto)).alias("__b1"),
    )
    spread = [side.repartition(tasks, "__b1", "__b2") for side in (one, two)]
    return spread[0].join(spread[1].hint("shuffle_hash"), ["__b1", "__b2"])


def unrank_pair(index: int, n: int) -> tuple[int, int]:
    """The pair ``i < j`` of ``n`` entities at a lexicographic index.

    ``i`` is the last row that starts at or before the index: a quadratic equation, solved in
    whole numbers and corrected.
    """
    i = max(0, (2 * n - 1 - isqrt(max((2 * n - 1) ** 2 - 8 * index, 0))) // 2)
    while i * (2 * n - i - 1) // 2 > index:
        i -= 1
    while (i + 1) * (2 * n - i - 2) // 2 <= index:
        i += 1
    return i, index - i * (2 * n - i - 1) // 2 + i + 1


def zip_by_row(*frames: DataFrame, on: str = ROW_ID) -> DataFrame:
    """Put tables side by side by row id; the first owner of a column name keeps it."""

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.drop(*[c for c in left.columns if c != on]), on, "inner")

    return reduce(attach, frames)


def attach_label(df: DataFrame, labels: DataFrame, on: str, label_key: str | None = None) -> DataFrame:
    """Left join of a category."""
    return df.join(labels.withColumnRenamed(label_key or on, on), on, "left")
