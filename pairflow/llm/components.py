"""Connected components of an edge table: trees per task, then alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.session import ensure_checkpoint_dir

#: Edges that a task contracts in the second pass, and nodes that it holds at most.
TASK_EDGES, TASK_NODES = 200_000, 1_000_000


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(parts).checkpoint()
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).coalesce(parts).checkpoint()
    tied = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def _forest(batches):
    """The edges of a task as stars: (smallest node, node) of each tree, roots with themselves.

    Nodes are forgotten when there are too many; later rounds join their trees.
    """
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars(kinds):
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], kinds), pa.array(nodes, kinds)], names=["a", "b"])

    kinds = None
    for batch in batches:
        kinds = batch.column("a").type
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > TASK_NODES:
            yield stars(kinds)
            parent.clear()
    if kinds is not None:
        yield stars(kinds)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node it reaches, for each node that an edge (a, b) names.

    Nodes are whole numbers.  Loops and repeated edges do no harm; edges with a null end are
    left out.  Each task first contracts its edges to trees; few enough trees are contracted
    again by fewer tasks, of at most about ``TASK_EDGES`` edges each.  If that is one task,
    all is done; else star rounds join the trees.  There minima are combined before each
    shuffle and no neighbour list is gathered, so a node with very many edges is no task of
    its own.  Each round is checkpointed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("a", "b").dropna()
    kind = edges.schema["a"].dataType.simpleString()
    contract = lambda df: df.mapInArrow(_forest, f"a {kind}, b {kind}").checkpoint()
    trees = contract(edges)
    parts = max(1, -(-trees.count() // TASK_EDGES))
    if parts < trees.rdd.getNumPartitions():
        trees = contract(trees.coalesce(parts))
    if parts == 1:
        return trees.select(F.col("b").alias("node"), F.col("a").alias("label"))
    nodes = trees.select(F.col("b").alias("node")).distinct()
    stars = trees.filter("a < b").distinct().coalesce(parts).checkpoint()
    before = _stamp(stars)
    while before[0]:
        stars = _small_star(_large_star(stars, parts).coalesce(parts).checkpoint(), parts).coalesce(parts).checkpoint()
        after = _stamp(stars)
        if after == before:
            break
        before = after
    labels = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
