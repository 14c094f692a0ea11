"""Session helpers: where shared files go, and a local session for tests."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder; on a cluster a
    lost executor would take its files with it, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="pairflow-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return local


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure ``DataFrame.checkpoint`` has a reliable folder to write to."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/pairflow-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The table, written to the shared folder and read back: as a checkpoint, in a fraction of its bytes.

    For tables as long as the input.  A checkpoint keeps rows as they lie in memory, these are
    columns, packed.  What Parquet does not hold (columns of no type, intervals, names that differ
    in case only) is checkpointed.
    """
    if len({c.lower() for c in df.columns}) < len(df.columns) or any(t in df.schema.simpleString() for t in ("void", "interval")):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Return what this process has freed to the machine; the C library and Arrow would keep it for as long as the driver runs.

    For after work on the driver whose arrays are gone.  A C library without ``malloc_trim`` keeps what it has.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def local_session(cores: int | str = 8, app_name: str = "pairflow") -> SparkSession:
    """Local session used by the tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
