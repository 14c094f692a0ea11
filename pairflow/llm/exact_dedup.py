"""Exact duplicates by content-defined chunk recipes.

A text is cut at places that its content gives: after a sentence end or a line end, at
least ``LEAST`` characters from the last cut (at most ``MOST``).  Chunk contents travel
once, to verify that each digest stands for one content; from there on a document is its
recipe, the ordered list of verified identifiers, and long texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.llm.common import ascii_lower, whole_text
from pairflow.session import ensure_checkpoint_dir

LEAST, MOST = 512, 4096
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[.!?\n]|.{{1,{MOST}}}"


def content_digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def content_chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text.  Empty text: none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous_digests(chunks: DataFrame, digest: Callable[[Column], Column] = content_digest) -> list:
    """Digests that more than one content of column ``chunk`` shares.

    The one step that moves contents: least and greatest content per digest, combined
    before the shuffle, so that a chunk travels once per task however often it occurs.
    With SHA-256 the list is empty; it is bounded by the collisions of the digest.
    """
    per_digest = chunks.groupBy(digest(F.col("chunk")).alias("digest")).agg(
        F.min("chunk").alias("least"), F.max("chunk").alias("greatest")
    )
    return [r[0] for r in per_digest.filter("least <> greatest").select("digest").collect()]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_digest
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical after lower-casing A-Z.  Of equal texts the
    largest id stays.  A null text counts as empty, and empty texts equal each other (an
    empty recipe).  Null ids lose against any id; rows that repeat the kept id are all
    marked kept and counted.  An empty table gives an empty result.  Other columns of
    ``docs`` are not read, whatever their names.  Runs two jobs when called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    normal = docs.select(docs[id_col].alias("doc_id"), ascii_lower(whole_text(docs, text)).alias("normal"))
    clashes = ambiguous_digests(normal.select(F.explode(content_chunks(F.col("normal"))).alias("chunk")), digest)
    identifier = digest
    if clashes:  # an ambiguous digest identifies nothing; its chunks stand for themselves
        bad = F.array(*[F.lit(x) for x in clashes])
        identifier = lambda c: F.when(F.array_contains(bad, digest(c)), c.cast("binary")).otherwise(digest(c).cast("binary"))
    recipes = normal.select(
        "doc_id",
        F.transform(content_chunks(F.col("normal")), identifier).alias("recipe"),
        F.sha2(F.col("normal"), 256).alias("text_sha256"),
    ).checkpoint()
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).checkpoint()
    # both sides are dealt out for the join, so that adaptive execution can split a hot group
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
