"""Table writers; the counting ones learn the row count from the write itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pairflow.operators.ordering import batch_id, row_index
from pairflow.operators.select import split_data_features
from pairflow.schema import ENTITY_COLUMNS, FEATURES, ROW_ID, TARGETS

BATCH_FILES = 64


@dataclass(frozen=True)
class Written:
    """Where a table went and how many rows it has."""

    path: str
    row_count: int


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    if not hasattr(df, "observe"):
        raise TypeError(f"Outputs of type {type(df)} not supported.")
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias("row_count")), observation


def write_parquet_counted(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = ()) -> Written:
    """``by`` makes a folder of each value of these columns."""
    observed, observation = _observed(df)
    observed.write.mode(mode).partitionBy(*by).parquet(path)
    done = Written(path, observation.get["row_count"])
    if by and not done.row_count:
        _keep_columns(df, path, by)
    return done


def _keep_columns(df: DataFrame, path: str, by: list[str]) -> None:
    """A table without rows has no folder of a value, and so no file: one without rows tells its columns."""
    columns = [c for c in df.columns if c not in by] + [*by]
    df.sparkSession.createDataFrame([], df.select(*columns).schema).write.mode("append").parquet(path)


def write_csv_counted(df: DataFrame, path: str, index: str | None = None, mode: str = "errorifexists") -> Written:
    """CSV with a header; ``index`` names an index column to put first."""
    observed, observation = _observed(df)
    if index is not None:
        observed = observed.select(index, *[c for c in observed.columns if c != index])
    observed.write.mode(mode).option("header", True).csv(path)
    return Written(path, observation.get["row_count"])


def write_batches(df: DataFrame, path: str, size: int, order: list[str | Column], fmt: str = "parquet", files: int | None = BATCH_FILES, compression: str | None = None) -> None:
    """Consecutive batches of at most ``size`` rows, in a column ``batch_id``; ``compression`` is the format's own if none is named.

    Batches are placed by range of their number, so each lies whole in one of at most
    ``files`` files, which hold many; ``batch_files`` says which.  ``files=None`` makes a
    folder of each batch instead, whose number then grows with the table.
    """
    numbered = batch_id(row_index(df, order, "__row"), size, "__row").drop("__row")
    named = {"header": True} | ({"compression": compression} if compression else {})
    if files is None:
        numbered.write.partitionBy("batch_id").options(**named).format(fmt).save(path)
    else:
        placed = numbered.repartitionByRange(files, "batch_id").sortWithinPartitions("batch_id")
        placed.write.options(**named).format(fmt).save(path)


def batch_files(spark: SparkSession, path: str) -> DataFrame:
    """Which file each batch lies in, and its rows: (batch_id, file, n)."""
    rows = spark.read.parquet(path).select("batch_id", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("batch_id", "file").agg(F.count(F.lit(1)).alias("n"))


def write_scores_json(df: DataFrame, path: str) -> None:
    """One JSON record per (model, holdout)."""
    df.write.json(path)


def write_split_tables(
    df: DataFrame,
    path: str,
    split: str = "split",
    ids: list[str] = ENTITY_COLUMNS,
    targets: list[str] = TARGETS,
    features: list[str] = FEATURES,
    row_id: str = ROW_ID,
) -> tuple[str, str]:
    """Data and features of every split, one folder per split under each."""
    data, extra = split_data_features(df, [split, *ids], targets, [split, *features], row_id)
    paths = f"{path}/data", f"{path}/features"
    for frame, target in zip((data, extra), paths):
        write_parquet_counted(frame, target, by=[split])
    return paths


def write_index_list(df: DataFrame, path: str, row_id: str = ROW_ID, compress: bool = False) -> None:
    """Selected row ids, one per line."""
    lines = df.select(F.col(row_id).cast("string"))
    lines.write.option("compression", "gzip" if compress else "none").text(path)
