"""From raw documents to a training mix, in five stages, each written before the next reads it.

1. toxicity: documents that the labelled examples call toxic go;
2. line dedup: boilerplate lines of a source go, documents stay;
3. near-dedup: of each group of near-duplicates the document with the smallest id stays;
4. decontamination: documents that hold a benchmark passage go;
5. mixing: each document comes as often as the target weights of the sources take it.

A stage is a function of (spark, docs, folder of the tables); all but the last return the
columns of ``documents``, with n_chars as the length of the text they return.

In every stage a null text counts as empty, a document is its id (null is one) with its text,
texts are read whole, columns of ``docs`` beside those of ``documents`` are not read, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairflow.llm.common import whole_text
from pairflow.llm.decontaminate import decontaminate
from pairflow.llm.line_dedup import line_dedup
from pairflow.llm.minhash import near_duplicates
from pairflow.llm.mixing import mix_sources
from pairflow.llm.toxicity import THRESHOLD, toxicity_rates
from pairflow.operators.ordering import row_index
from pairflow.operators.sizing import measured
from pairflow.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Toxicity, near-duplicates and mixing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay, each judged by its own score: a copy under another id is judged apart.

    Rows that repeat a document stay or go together; a score at the threshold is rejected.  An
    empty text has the rate of such examples.  Without labels of both kinds nothing is learned,
    and all have the rate of the labels there are.
    """
    rates = toxicity_rates(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    toxic = measured(rates.filter(F.col("s.score") >= THRESHOLD).select("doc_id", "text_key").distinct())
    return keyed(docs).alias("d").join(toxic.alias("k"), same_document("d", "k"), "left_anti").select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row comes back, repeated ones each, less the lines that too many documents of its source share.

    A null source is a source.  A document of nothing but such lines, or without a text, has an empty one.
    """
    cleaned = line_dedup(docs.select(*COLUMNS), carry=["lang", "source"])
    return cleaned.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and the hash of the text."""
    return docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(whole_text(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text of an id, and of no id, is a document of its own; rows that repeat both are one.

    Of a group the document with the smallest id stays, of one id the text with the smallest
    hash, of repeated rows the one with the smallest other columns.  Empty texts link with
    nothing and stay.
    """
    rows = keyed(docs)
    keys = row_index(rows.select("doc_id", "text_key").distinct(), [F.col("doc_id").asc_nulls_last(), F.col("text_key")], "row")
    numbered = rows.alias("d").join(measured(keys).alias("k"), same_document("d", "k")).select(*[F.col(f"d.{c}") for c in COLUMNS], "k.row")
    kept = near_duplicates(numbered, "row").filter("kept").select(F.col("doc_id").alias("row")).distinct()
    stay = numbered.join(measured(kept), "row", "left_semi")
    one = stay.groupBy("row").agg(F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("one"))
    return one.select(*[F.col(f"one.{c}") for c in COLUMNS])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit stay, repeated rows each; with an empty benchmark all do."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    clean = found.filter(~F.col("contaminated")).select("doc_id", "text_key").distinct()
    return keyed(docs).alias("d").join(clean.alias("k"), same_document("d", "k"), "left_semi").select(*COLUMNS)


def same_document(a: str, b: str):
    """Join condition of two aliases by text and id; null ids match each other."""
    return F.expr(f"{a}.text_key = {b}.text_key and {a}.doc_id <=> {b}.doc_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy the mix takes: the columns of documents, ``size`` in words, ``copies`` and the number of the copy.

    A null source is a source; documents without words are never taken.  Repeated rows of a
    document and source come as that document, as often as all of them are taken.
    """
    mixed = mix_sources(docs.select(*COLUMNS)).filter("copies > 0")
    taken = mixed.groupBy("doc_id", "text_key", "source").agg(F.first("size").alias("size"), F.sum("copies").alias("copies"))
    rows = keyed(docs).dropDuplicates(["doc_id", "text_key", "source"])
    same = F.expr("d.text_key = m.text_key and d.doc_id <=> m.doc_id and d.source <=> m.source")
    joined = rows.alias("d").join(taken.alias("m"), same)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.copies"))).alias("copy")
    return joined.select(*[F.col(f"d.{c}") for c in COLUMNS], "m.size", "m.copies", copy)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
