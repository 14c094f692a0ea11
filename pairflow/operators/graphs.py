"""Neighbour graphs of fingerprints and their spectral embedding: the nonlinear way to clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairflow.functions import fixed
from pairflow.operators.ordering import row_index
from pairflow.session import ensure_checkpoint_dir

NEIGHBOURS, BLOCK = 15, 512
ROUNDS = 30


def _bits(members: pa.Array, bits: int) -> np.ndarray:
    """Members of a block as rows of 0 and 1."""
    lists = members.field("bits")
    out = np.zeros((len(members), bits), dtype=np.float32)
    out[np.repeat(np.arange(len(members)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = 1.0
    return out


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shared = (a @ b.T).astype(np.float64)
    union = a.sum(axis=1, dtype=np.float64)[:, None] + b.sum(axis=1, dtype=np.float64) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def _own_floor(k: int, bits: int):
    """For each member of a block, the k-th similarity within the block: a bound from below."""

    def run(batches):
        for batch in batches:
            floors = []
            for members in batch.column("members"):
                a = _bits(members.values, bits)
                s = _similarity(a, a)
                np.fill_diagonal(s, -1.0)
                floors.append(np.sort(s, axis=1)[:, -k].tolist() if len(a) > k else [0.0] * len(a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.float64()))], [*batch.schema.names, "floors"])

    return run


def _between(k: int, bits: int):
    """The k nearest of each member in the other block of a pair, as far as they can count."""

    def nearest(s, floor, ids, others):
        for i in range(len(s)):
            close = np.flatnonzero((s[i] >= floor[i]) & (s[i] > 0))
            if len(close) > k:
                close = close[np.lexsort((others[close], -s[i][close]))[:k]]
            yield ids[i], others[close], s[i][close]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].values for c in ("members_a", "members_b"))
                ids_a, ids_b = (v.field("place").to_numpy() for v in (a, b))
                s = _similarity(_bits(a, bits), _bits(b, bits))
                same = batch.column("a")[r].as_py() == batch.column("b")[r].as_py()
                if same:
                    np.fill_diagonal(s, -1.0)
                floor_a, floor_b = (np.array(batch.column(c)[r].as_py()) for c in ("floors_a", "floors_b"))
                found = list(nearest(s, floor_a, ids_a, ids_b))
                found += [] if same else list(nearest(s.T, floor_b, ids_b, ids_a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "place": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
                        "other": np.concatenate([f[1] for f in found]).astype(np.int64),
                        "similarity": np.concatenate([f[2] for f in found]),
                    }
                )

    return run


def neighbour_graph(df: DataFrame, id_column: str, bits: str, k: int = NEIGHBOURS, size: int = fixed.FINGERPRINT_BITS, block: int = BLOCK) -> DataFrame:
    """The exact ``k`` nearest by Jaccard similarity of each entity: id, neighbour, similarity, rank.

    ``bits`` is an array of bit positions below ``size``; of equal similarities the smaller id
    comes first, and entities without a common bit are no neighbours.  Entities are ordered by
    the number of their bits and cut into blocks.  What a member finds in its own block bounds
    its k-th similarity from below, and two blocks whose sizes alone keep all their pairs under
    that are never compared.  Ids must be unique; rows with a NULL id are left out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sets = df.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.array_distinct(bits).alias("bits"))
    numbered = row_index(sets.withColumn("n", F.size("bits")), ["n", "id"], "at")
    ranked = row_index(numbered.select("id", "at"), ["id"], "place")  # ties go by the order of ids
    members = numbered.join(ranked.select("at", "place"), "at").withColumn("block", F.floor(F.col("at") / block))
    blocks = members.groupBy("block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.sort_array(F.collect_list(F.struct("place", F.col("bits").cast("array<int>").alias("bits")))).alias("members")
    )
    kinds = "block long, low int, high int, members array<struct<place: long, bits: array<int>>>"
    floored = blocks.mapInArrow(_own_floor(k, size), f"{kinds}, floors array<double>").withColumn("floor", F.array_min("floors")).checkpoint()
    about = floored.select("block", "low", "high", "floor")
    last = about.agg(F.max("block")).first()[0]
    if last is None:
        return sets.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    a = about.select(F.col("block").alias("a"), F.col("high").alias("high_a"), F.col("floor").alias("floor_a"), F.explode(F.sequence("block", F.lit(last))).alias("b"))
    b = about.select(F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("floor").alias("floor_b"))
    most = F.least(F.lit(1.0), F.col("high_a") / F.greatest("low_b", F.lit(1)))
    needed = a.join(b, "b").filter(most >= F.least("floor_a", "floor_b") - F.lit(1e-12)).select("a", "b")
    side = lambda s: floored.select(F.col("block").alias(s), F.col("members").alias(f"members_{s}"), F.col("floors").alias(f"floors_{s}"))
    pairs = needed.join(side("a"), "a").join(side("b"), "b")
    found = pairs.mapInArrow(_between(k, size), "place long, other long, similarity double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("similarity"), "other"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = ranked.select("place", "id")
    return (
        kept.join(names, "place")
        .join(names.select(F.col("place").alias("other"), F.col("id").alias("neighbour")), "other")
        .select("id", "neighbour", "similarity", "rank")
    )


def spectral_embedding(edges: DataFrame, dims: int = 5, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """Coordinates e0 .. of each node of (id, neighbour, similarity): leading vectors of the normalised graph.

    Orthogonal iteration: a round is one join of the edges with the vectors and one small
    matrix of products.  The constant vector is taken out exactly, so groups without edges
    between them differ in the first coordinates.  Signs and equal values are arbitrary, but
    the same in each run.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("id", "neighbour", "similarity").unionByName(edges.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "similarity"))
    links = both.filter("id <> neighbour").groupBy("id", "neighbour").agg(F.max("similarity").alias("w")).checkpoint()
    names = [f"e{j}" for j in range(dims)]
    draw = lambda j: F.xxhash64(F.col("id").cast("string"), F.lit(seed), F.lit(j)) / F.lit(float(2**63))
    x = links.groupBy("id").agg(F.sqrt(F.sum("w")).alias("root")).select("id", "root", *[draw(j).alias(n) for j, n in enumerate(names)])
    x = x.checkpoint()
    mass = x.agg(F.sum(F.col("root") * F.col("root"))).first()[0]
    values = np.zeros(dims)
    for step in range(rounds + 1):
        pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
        sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs] + [F.sum(F.col(n) * F.col("root")) for n in names]
        got = np.array(x.agg(*sums).first(), dtype=float)
        constant = got[len(pairs) :] / mass
        g = np.zeros((dims, dims))
        for (i, j), v in zip(pairs, got):
            g[i, j] = g[j, i] = v
        g -= np.outer(constant, constant) * mass
        size, axes = np.linalg.eigh(g)
        turn = axes[:, ::-1] / np.sqrt(np.maximum(size[::-1], 1e-300))
        turn = np.where(size[::-1] > 1e-14 * size[-1], turn, 0.0)
        free = [F.col(n) - F.lit(float(c)) * F.col("root") for n, c in zip(names, constant)]
        turned = [sum((free[i] * F.lit(float(turn[i, j])) for i in range(dims)), F.lit(0.0)).alias(n) for j, n in enumerate(names)]
        x = x.select("id", "root", *turned)
        settled = step and np.abs(size[::-1] - values).max() < 1e-6
        values = size[::-1]
        if step == rounds or settled:
            break
        x = x.checkpoint()
        ahead = x.select(F.col("id").alias("neighbour"), *[(F.col(n) / F.col("root")).alias(n) for n in names])
        moved = links.join(ahead, "neighbour").groupBy("id").agg(*[F.sum(F.col("w") * F.col(n)).alias(f"m_{n}") for n in names])
        half = [((F.col(n) + F.col(f"m_{n}") / F.col("root")) / 2).alias(n) for n in names]
        x = x.join(moved, "id").select("id", "root", *half).checkpoint()
    return x.select("id", *[(F.col(n) / F.col("root")).alias(n) for n in names])
