"""Jobs in stages that a restart picks up where the last run ended."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairflow.sources.writers import write_parquet_counted

RECORD = "name string, digest string, n_rows long, path string"


def content_digest(df: DataFrame) -> str:
    """Digest of columns and rows, whatever their order: the row count and the sum of the rows' hashes."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(hashed)).first()
    return _digest(sorted(df.dtypes), n, str(total))


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """Tables of a job under one shared folder, with a manifest of the finished ones.

    A stage is known by its name and a digest of its settings and of what it was made from,
    so other inputs or settings never meet an old table.  Its table goes to a new folder; only
    when that is complete is its record added to the manifest (name, digest, n_rows, path).
    A run that dies leaves a folder no record names, and the next run makes the stage anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.made: list[str] = []
        self._digests: dict[str, str] = {}
        self._tables: dict[str, DataFrame] = {}
        # An empty manifest, so that there is one to read; appending nothing to a full one changes nothing.
        spark.createDataFrame([], RECORD).write.mode("append").json(self._manifest)

    @property
    def _manifest(self) -> str:
        return f"{self.path}/manifest"

    def manifest(self) -> DataFrame:
        """The records of all finished stages, of earlier runs too."""
        return self.spark.read.schema(RECORD).json(self._manifest)

    def source(self, name: str, df: DataFrame, version: str | None = None) -> DataFrame:
        """An input.  Without a ``version`` its rows are read once for their digest."""
        self._digests[name] = _digest(name, version) if version is not None else content_digest(df)
        self._tables[name] = df
        return df

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def run(self, name: str, make: Callable[..., DataFrame], after: list[str], settings: dict | None = None, by: list[str] = ()) -> DataFrame:
        """The stage's table: read if it is in the manifest, else made from the tables of ``after`` and written.

        ``by`` makes a folder of each value of these columns.
        """
        digest = _digest(name, settings or {}, list(by), [(a, self._digests[a]) for a in after])
        found = self.manifest().filter((F.col("name") == name) & (F.col("digest") == digest)).first()
        if found is None:
            done = write_parquet_counted(make(*[self._tables[a] for a in after]), f"{self.path}/{name}-{uuid.uuid4().hex}", by=by)
            record = self.spark.createDataFrame([(name, digest, done.row_count, done.path)], RECORD)
            record.coalesce(1).write.mode("append").json(self._manifest)
            self.made.append(name)
            path = done.path
        else:
            path = found["path"]
        self._digests[name] = digest
        self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]
