"""Near-duplicates by b-bit MinHash.

Each set of word shingles gets ``BANDS * ROWS`` minima.  Full minima make the band keys that
yield candidates; of each minimum only the low ``BITS`` bits are kept, packed in longs.
Candidates are rated by counting equal bit groups, corrected for chance collisions, and the
ones that could reach the threshold are confirmed on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairflow.llm.common import slices_of, whole_text
from pairflow.llm.components import connected_components
from pairflow.llm.shingles import U64, WordHashes, mix, shingle_set
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 4
#: Candidates rated this many standard deviations below the threshold are not confirmed.
MARGIN = 4.5
#: Minima and bits of the finer signature by which pairs across components are rated.
FINE, FINE_BITS = 2048, 2
BLOCK = 1024
SLICE = 2048


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_501)
    return draw.integers(0, 2**63, count, dtype=U64) * U64(2) + U64(1), draw.integers(0, 2**63, count, dtype=U64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each permutation over a set, a slice of the set at a time."""
    least = np.full(len(a), np.iinfo(U64).max, dtype=U64)
    for i in range(0, len(values), SLICE):
        moved = values[i : i + SLICE, None] * a
        moved += b
        np.minimum(least, moved.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=U64)
    for r in range(rows.shape[1]):
        key = mix(key * U64(31) + rows[:, r])
    return key


def packed_bits(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each minimum, ``64 // bits`` minima to a long."""
    per_long = 64 // bits
    low = (least & U64((1 << bits) - 1)).reshape(-1, per_long)
    return np.bitwise_or.reduce(low << (np.arange(per_long, dtype=U64) * U64(bits)), axis=1)


def _features(shingle: int, bands: int, rows: int, bits: int):
    def run(batches):
        hashes, (a, b) = WordHashes(), permutations(bands * rows)
        for batch in slices_of(batches):
            sizes, high, low, keys, signs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text.encode().lower().split(), hashes, shingle)
                sizes.append(len(values))
                whole = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), dtype=np.int64)
                high.append(whole[0])
                low.append(whole[1])
                least = minima(values, a, b) if len(values) else np.empty(0, dtype=U64)
                keys.append(band_keys(least, bands).view(np.int64) if len(values) else [])
                signs.append(packed_bits(least, bits).view(np.int64) if len(values) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(keys, longs),
                    pa.array(signs, longs),
                ],
                names=["doc_id", "n_shingles", "set_high", "set_low", "band_keys", "sign"],
            )

    return run


def features(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (set_high, set_low), band_keys, sign (packed low bits) of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_high long, set_low long, band_keys array<long>, sign array<long>"
    return docs.select("doc_id", "text").mapInArrow(_features(shingle, bands, rows, bits), schema)


def _fine(shingle: int, count: int, bits: int):
    def run(batches):
        hashes, (a, b) = WordHashes(), permutations(count)
        for batch in slices_of(batches):
            sets = [shingle_set(t.encode().lower().split(), hashes, shingle) for t in batch.column("text").to_pylist()]
            signs = [packed_bits(minima(s, a, b), bits).view(np.int64) for s in sets]
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "sign"])

    return run


def rated(x: Column, y: Column, count: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity estimate of two packed signatures: equal groups by bit counts, less what equals by chance."""
    first = sum(1 << i for i in range(0, 64, bits))
    first = first - (1 << 64) if first >= 1 << 63 else first
    differs = F.lit(0)
    for i in range(count * bits // 64):
        delta = x[i].bitwiseXOR(y[i])
        folded = delta
        for s in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(delta, s))
        differs = differs + F.bit_count(folded.bitwiseAND(F.lit(first)))
    chance = 2.0**-bits
    return (1 - differs / F.lit(float(count)) - chance) / (1 - chance)


def least_rating(percent: int, count: int = BANDS * ROWS, bits: int = BITS) -> float:
    chance = 2.0**-bits
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - MARGIN * math.sqrt(equal * (1 - equal) / count) / (1 - chance)


def _sets(shingle: int):
    def run(batches):
        hashes = WordHashes()
        for batch in slices_of(batches):
            values = [shingle_set(t.encode().lower().split(), hashes, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "members"])

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough.  Only texts that some pair names are read into sets."""
    named = measured(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.join(named, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(shingle), f"doc_id {kind}, members array<long>")
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    enough = both * 100 >= (F.size("of_a") + F.size("of_b") - both) * percent
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b").distinct()


def _pairs(percent: int, count: int, bits: int):
    ones = U64(sum(1 << i for i in range(0, 64, bits)))
    chance, least = 2.0**-bits, least_rating(percent, count, bits)

    def run(table: pa.Table) -> pa.Table:
        node, label, size, block = (table.column(c).to_numpy() for c in ("node", "label", "size", "block"))
        signs = np.array(table.column("sign").to_pylist(), dtype=np.int64).view(U64)
        key, keys, out = table.column("key")[0].as_py(), table.column("keys").to_pylist(), []
        first = block == block.min()
        for k in np.flatnonzero(first):
            other = ~first if not first.all() else np.arange(len(node)) > k
            other &= (label != label[k]) & (np.minimum(size, size[k]) * 100 >= np.maximum(size, size[k]) * percent)
            at = np.flatnonzero(other)
            differs = signs[at] ^ signs[k]
            for s in range(1, bits):
                differs |= (signs[at] ^ signs[k]) >> U64(s)
            equal = 1 - np.bitwise_count(differs & ones).sum(axis=1) / count
            for m in at[(equal - chance) / (1 - chance) >= least]:
                if min(set(keys[k]) & set(keys[m])) == key:  # of several shared buckets, one names the pair
                    out.append((min(node[k], node[m]), max(node[k], node[m])))
        kind = table.schema.field("node").type
        return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i in (0, 1)], names=["a", "b"])

    return run


def bucket_pairs(members: DataFrame, percent: int, count: int, bits: int) -> DataFrame:
    """Pairs (a, b) of different labels in a bucket that are rated high enough, and not too unlike in size.

    ``members``: key, node, label, size, sign and the keys of all buckets of the node.  A
    bucket is cut into blocks of about ``BLOCK`` members and each pair of blocks is a group of
    its own, so that no task gets a large bucket whole.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).checkpoint()
    cut = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = members.schema["node"].dataType.simpleString()
    return dealt.groupBy("key", "i", "j").applyInArrow(_pairs(percent, count, bits), f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets are the distinct runs of ``shingle`` words after lower-casing A-Z; of fewer words
    the whole sequence is the one member; without words the set is empty and linked with
    nothing.  Documents are linked when 100 * intersection >= percent * union, on full sets.
    ``component_id`` is the smallest id reachable, ``kept`` marks the row that has it.

    Equal sets are one class with one representative, so copies are never paired.  In each
    bucket, first every member meets the one that shares its buckets with most others, the
    likely original of a group; buckets whose members are then in one component are done, in
    the others all pairs across components are rated.  No bucket is capped.

    A pair at the threshold shares a bucket with probability 1 - (1 - s**rows)**bands, at 75 %
    and the defaults all but 5 in a million; its rating is too low for 4 in a million.  Null texts count as empty.  Rows that share an id
    are one document, linked as any of its texts is.  A row with a null id links with nothing;
    its component is null and it is kept.  An empty table gives an empty result; other columns
    are not read.  Ids must be whole numbers.  Runs jobs when called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text).alias("text"))
    seen = features(texts, shingle, bands, rows, bits).checkpoint()
    linkable = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("node")).checkpoint()
    copies = linkable.join(classes, ["set_high", "set_low"]).filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    nodes = (
        linkable.join(classes.withColumnRenamed("node", "doc_id"), ["set_high", "set_low", "doc_id"], "left_semi")
        .dropDuplicates(["set_high", "set_low", "doc_id"])
        .select(F.col("doc_id").alias("node"), "band_keys", "sign")
        .checkpoint()
    )
    count, least = bands * rows, least_rating(percent, bands * rows, bits)
    placed = nodes.select("node", F.explode("band_keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    crowd = placed.join(shared, "key").checkpoint()
    fame = crowd.groupBy("node").agg(F.sum("n").alias("fame")).checkpoint()
    famous = crowd.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", -F.col("node")))["col2"].alias("hub"))
    hubs = famous.select("key", (-F.col("hub")).alias("hub")).checkpoint()
    buckets = crowd.select("key", "node")

    signs = nodes.select("node", "sign")
    to_hub = buckets.join(hubs, "key").filter("node <> hub").select("node", "hub").distinct()
    rating = rated(F.col("s.sign"), F.col("h.sign"), count, bits)
    stars = (
        to_hub.alias("p").join(signs.alias("s"), F.expr("p.node = s.node")).join(signs.alias("h"), F.expr("p.hub = h.node"))
        .select("p.node", "p.hub", rating.alias("rating")).filter(F.col("rating") >= least)
    )
    first = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().checkpoint()
    links = confirmed(texts, first, shingle, percent).checkpoint()

    labels = connected_components(links)
    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")).checkpoint()
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("key").checkpoint()
    open_ = named.join(mixed, "key", "left_semi").checkpoint()
    open_nodes = open_.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")).checkpoint()
    kind = texts.schema["doc_id"].dataType.simpleString()
    fine = (
        texts.join(measured(open_nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").filter("text <> ''")
        .mapInArrow(_fine(shingle, FINE, FINE_BITS), f"node {kind}, size long, sign array<long>").dropDuplicates(["node", "size", "sign"])
    )
    left_over = open_.join(open_nodes.join(fine, "node").checkpoint(), "node")
    rest = bucket_pairs(left_over, percent, FINE, FINE_BITS).join(first, ["a", "b"], "left_anti").checkpoint()
    links = links.union(confirmed(texts, rest, shingle, percent)).union(copies).checkpoint()

    final = connected_components(links)
    joined = seen.alias("d").join(final.alias("c"), F.expr("d.doc_id = c.node"), "left")
    component = F.coalesce("c.label", "d.doc_id")
    return joined.select("d.doc_id", "d.n_shingles", component.alias("component_id"), F.col("d.doc_id").eqNullSafe(component).alias("kept"))
