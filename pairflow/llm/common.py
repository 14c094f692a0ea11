"""What the operators of this subpackage share: text normalisation, keys, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 512


def ascii_lower(c: Column) -> Column:
    """Lower-cased A-Z only; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def whole_text(docs: DataFrame, text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def with_text_key(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, text and text_key: rows that repeat an id with another text stay apart."""
    whole = whole_text(docs, text)
    return docs.select(docs[id_col].alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"), *more)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition of two tables keyed by (doc_id, text_key); null ids match each other."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def slices_of(batches, rows: int = SLICE_ROWS):
    """The batches in slices, so that a task has the Python objects of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
