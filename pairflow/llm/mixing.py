"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S is wanted T / S times.  The whole part is
taken; the fraction is a probability.  Two fractions at a time, one gives expected words to
the other, at random but without changing their sum, until one is 0 or 1.  Blocks of documents of like
size do this side by side, each leaves one open fraction at most, and these are paired again
up a tree, until a class of sizes has one left, which is rounded.  The large documents of a
source come first; what their rounding misses is spread over its small ones, which are kept
open until then, so that in the end a source misses its target by part of a small document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairflow.llm.common import WORD, whole_text
from pairflow.llm.shingles import U64, mix
from pairflow.operators.ordering import row_index
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir

WEIGHTS, MOST = (1, 2, 3), 3
BLOCK_ROWS, FAN = 10_000, 64
#: Words that a source's small documents can take up or give, over its largest document; half of all where that is less.
RESERVE = 1.5
COPIES = 10_000
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target for (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last.  Targets share the sum of all
    sizes; one that would exceed ``most`` times its size stops there, and the excess is shared
    anew by weight among the others, until none is above.
    """
    spark = sizes.sparkSession
    ordered = row_index(sizes.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    open_, done = ordered.select("source", "source_size", weight.alias("weight"), F.lit(None).cast("double").alias("target")).checkpoint(), None
    left = float(open_.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        mass = open_.agg(F.sum("weight")).first()[0]
        if not mass:
            break
        share, ceiling = F.col("weight") / mass * left, F.col("source_size") * float(most)
        above = open_.filter(share > ceiling).withColumn("target", ceiling).checkpoint()
        taken = above.agg(F.sum("target"), F.count("*")).first()
        if not taken[1]:
            open_ = open_.withColumn("target", share)
            break
        done = above if done is None else done.unionByName(above)
        open_ = open_.filter(~(share > ceiling)).checkpoint()
        left -= taken[0]
    return (open_ if done is None else open_.unionByName(done)).select("source", "source_size", "target")


def settle(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pair the fractions in order; the new values (0 or 1 but for one), and the place of the one left open or -1.

    The mass is expected words, so a transfer changes neither the sum of ``p * size`` nor,
    on average over the draws, any ``p``.
    """
    p, carrier = p.copy(), -1
    for i in np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON)):
        if not size[i]:
            p[i] = draws[i] < p[i]
            continue
        if carrier < 0:
            carrier = i
            continue
        up = min((1 - p[carrier]) * size[carrier], p[i] * size[i])
        down = min(p[carrier] * size[carrier], (1 - p[i]) * size[i])
        moved = up if draws[i] * (up + down) < down else -down
        p[carrier] += moved / size[carrier]
        p[i] -= moved / size[i]
        still = [k for k in (carrier, i) if EPSILON < p[k] < 1 - EPSILON]
        carrier = still[0] if still else -1
    whole = np.where(p > 0.5, 1.0, 0.0)
    if carrier >= 0:
        whole[carrier] = p[carrier]
    return whole, int(carrier)


def _settle_group(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        size, tie = table.column("size").to_numpy(), table.column("tie").to_numpy()
        order = np.lexsort((tie, -size))  # large documents first, so that what stays open is small
        table = table.take(pa.array(order))
        salt = U64((seed * 1_000_003 + level * 7_919) % 2**64)
        draws = mix(tie[order].view(U64) ^ salt).astype(np.float64) / 2.0**64
        p, carrier = settle(table.column("p").to_numpy(), size[order], draws)
        if last and carrier >= 0:
            p[carrier] = round(p[carrier])  # one document of a source; the nearer end keeps the words near the target
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return run


def settled_rows(rows: DataFrame, seed: int, levels: int, together: bool = False) -> DataFrame:
    """The rows with ``p`` 0 or 1, and ``was`` before: blocks first, then what they leave open up a tree.

    In the end a class of a source has one open document, which is rounded; ``together``: the
    open ones of all classes of a source are paired once more before.
    """
    rows = rows.withColumn("was", F.col("p"))
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    settled = None
    steps = [["source", "class", "block"]] * levels + [["source"] if together else ["source", "class"]]
    for level, by in enumerate(steps):
        last = level == len(steps) - 1
        done = rows.groupBy(*by).applyInArrow(_settle_group(seed, level, last), schema).checkpoint()
        closed = done if last else done.filter(f"p <= {EPSILON} or p >= 1 - {EPSILON}")
        settled = closed if settled is None else settled.unionByName(closed)
        rows = done.filter(f"p > {EPSILON} and p < 1 - {EPSILON}").withColumn("block", F.floor(F.col("block") / FAN).cast("int")).select(*columns)
    return settled


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0); ``taken`` is size * copies.  Copies never exceed
    ``most``.  The choice depends on the rows and ``seed`` only, not on their order or
    partitioning.  Null sources are one source, the last; null ids and repeated rows are
    documents like others, each comes back.  An empty table, or a source without words, has
    nothing to take.  Other columns are not read.  Runs jobs when called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    whole = whole_text(docs, text)
    counted = docs.select(
        docs[id_col].alias("doc_id"),
        F.xxhash64(whole).alias("text_key"),
        docs[source].alias("source"),
        F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"),
    ).groupBy("doc_id", "text_key", "source", "size").agg(F.count("*").alias("m"))
    # repeated rows get a number each, a part of a large group at a time
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES)))).repartition("doc_id", "text_key", "part")
    in_part = F.least(F.lit(COPIES).cast("long"), F.col("m") - F.col("part") * COPIES)
    sized = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), in_part))).select(
        "doc_id", "text_key", "source", "size", F.xxhash64("doc_id", "text_key", "part", "copy").alias("tie"), F.floor(F.log2(F.col("size") + 1.0) * 2).cast("int").alias("class")
    ).checkpoint()
    classes = sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("largest")).checkpoint()
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    fraction = F.col("times") - F.floor("times")
    below = F.sum("words").over(Window.partitionBy("source").orderBy("class")) - F.col("words")
    room = F.least(fraction, 1 - fraction) * below
    plan = (
        classes.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source"))
        .select("c.source", "class", "words", "largest", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "source_size", "target", times.alias("times"))
        .withColumn("enough", room >= F.least(RESERVE * F.max("largest").over(Window.partitionBy("source")), F.least(fraction, 1 - fraction) * F.col("source_size") / 2))
        .drop("words", "largest")
        .checkpoint()
    )
    most_blocks = plan.agg(F.max("blocks")).first()[0] or 1
    rows = (
        sized.alias("d").join(measured(plan).alias("p"), F.expr("d.source <=> p.source and d.class = p.class"))
        .select("d.*", "source_size", "target", F.floor("times").cast("long").alias("base"),
                fraction.alias("p"), F.pmod(F.xxhash64("tie", F.lit(1)), "blocks").cast("int").alias("block"), "enough")
    )
    levels = 1 + math.ceil(math.log(max(most_blocks, 1), FAN))
    large = settled_rows(rows.filter("enough").drop("enough"), seed, levels)
    small = rows.filter("not enough").drop("enough")
    missed = large.groupBy("source").agg(F.sum((F.col("p") - F.col("was")) * F.col("size")).alias("missed"))
    open_words = small.groupBy("source").agg(F.sum("size").alias("open_words"))
    shift = measured(open_words.alias("o").join(missed.alias("m"), F.expr("o.source <=> m.source")).filter("open_words > 0").select("o.source", (F.col("missed") / F.col("open_words")).alias("shift")))
    names = [F.col(f"r.{c}") for c in small.columns if c != "p"]
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r.p") - F.coalesce("s.shift", F.lit(0.0))))
    shifted = small.alias("r").join(shift.alias("s"), F.expr("r.source <=> s.source"), "left").select(*names, moved.alias("p"))
    settled = large.unionByName(settled_rows(shifted, seed, levels, together=True))
    copies = F.col("base") + F.round("p").cast("long")
    return settled.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
