"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairflow.functions import fixed
from pairflow.operators.sizing import measured

INDEX_COLUMNS = ("Unnamed: 0", "_c0", "")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Missing-value words to NULL, the rest cast to the declared types."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{f.name}`")
        known = F.when(~F.trim(text).isin(fixed.NULL_TOKENS), text)
        out.append((known if isinstance(f.dataType, T.StringType) else F.trim(known).try_cast(f.dataType)).alias(f.name))
    return df.select(out)


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header, by column name; a stray index column is left out.

    Columns are read as text because many words mean "missing" and the reader knows
    one; declared columns the files lack come out NULL.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return _typed(raw, schema)


def scan_csv_batches(spark: SparkSession, paths: str | list[str], schema: T.StructType, one_layout: bool = False) -> DataFrame:
    """Concatenate CSV batches whose headers may differ, matching columns by name.

    The header of each file is a row of a side table that is joined to the lines, which are
    parsed by position and picked by that header: one scan of the data whatever the number
    of layouts and files.  Only the largest number of columns comes to the driver.
    ``one_layout`` says that all headers are alike, which saves looking for them.  A quoted
    value may not hold a line break.
    """
    if one_layout:
        return scan_csv(spark, paths, schema)
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")
    )
    heads = lines.filter((F.col("at") == 0) & (F.col("value") != "")).groupBy("path").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("header"))
    heads = measured(heads)
    quoted = F.length("header") - F.length(F.replace("header", F.lit(",")))
    width = (heads.agg(F.max(quoted)).first()[0] or 0) + 1
    fields = ", ".join(f"c{i} string" for i in range(width))
    values = lambda c: F.array(*[F.from_csv(c, fields)[f"c{i}"] for i in range(width)])
    known = lines.filter(F.col("value") != "").join(heads, "path")
    body = known.filter(F.col("line") != F.col("first"))
    parsed = body.select(F.from_csv("value", fields).alias("__v"), values("header").alias("__names"))
    listed = parsed.select(F.array(*[F.col(f"__v.c{i}") for i in range(width)]).alias("__v"), "__names")
    place = lambda name: F.array_position("__names", name).cast("int") - 1
    picked = [F.when(place(f.name) >= 0, F.get("__v", place(f.name))).alias(f.name) for f in schema.fields]
    return _typed(listed.select(*picked), schema)


def scan_tagged_files(spark: SparkSession, path: str, fmt: str = "parquet", name: str = "source", **options) -> DataFrame:
    """All files of a glob as one table, each row tagged with its file's stem."""
    df = spark.read.format(fmt).options(**options).load(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return df.select("*", stem.alias(name))


def scan_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 1,
    **options,
) -> DataFrame:
    """Whole table over JDBC, in parallel ranges when a numeric column is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        lo, hi = bounds
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lo, upperBound=hi, numPartitions=num_partitions
        )
    return reader.load()
