"""Where each layer's tables live, and how they are read and published.

A table is a folder of data folders, each written once, and of numbered commits. A commit is a small file that
lists the data folders of one version. A write fills a new data folder, then creates the next commit by a rename
that does not replace; readers take the highest commit. So a reader sees a whole version or the one before, a failed
write leaves the table as it was, and of two writers that publish the same version one is told.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LAYERS = ("landing", "raw", "base", "semantic", "reference-tables")
COMMITS = "_commits"
KEEP = 3  # versions whose data stays


class CommitConflictError(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Lake:
    """A root folder or URI with one folder per layer and one dataset per table."""

    root: str

    def path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}, expected one of {LAYERS}")
        return f"{self.root.rstrip('/')}/{layer}/{table}"

    def read(self, spark: SparkSession, layer: str, table: str) -> DataFrame:
        """The latest version; a folder without commits is read as plain Parquet."""
        return PublishedTable(spark, self.path(layer, table)).read()

    def write(self, df: DataFrame, layer: str, table: str, cluster_by: Iterable[str] = ()) -> dict[str, int]:
        """Publish ``df`` as the next version; returns its row and null counts, observed during the write."""
        return PublishedTable(df.sparkSession, self.path(layer, table)).write(_clustered(df, cluster_by))

    def append(self, df: DataFrame, layer: str, table: str) -> dict[str, int]:
        """Publish a version with the rows of the latest one and those of ``df``."""
        return PublishedTable(df.sparkSession, self.path(layer, table)).write(df, keep_rows=True)

    def rollback(self, spark: SparkSession, layer: str, table: str) -> int:
        """Publish the version before the latest one anew; returns its new number."""
        return PublishedTable(spark, self.path(layer, table)).rollback()


def _clustered(df: DataFrame, by: Iterable[str]) -> DataFrame:
    by = list(by)
    return df.sortWithinPartitions(*by) if by else df


class PublishedTable:
    """One table: its commits and its data folders, through the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def versions(self) -> list[int]:
        """Numbers of the commits, oldest first."""
        folder = self._at(f"{self.path}/{COMMITS}")
        if not self._fs.exists(folder):
            return []
        names = (entry.getPath().getName() for entry in self._fs.listStatus(folder))
        return sorted(int(name) for name in names if name.isdigit())

    def folders(self, version: int) -> list[str]:
        """Names of the data folders of a version."""
        stream = self._fs.open(self._at(f"{self.path}/{COMMITS}/{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        if not versions and version is None:
            return self.spark.read.parquet(self.path)
        names = self.folders(versions[-1] if version is None else version)
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in names])

    def write(self, df: DataFrame, keep_rows: bool = False) -> dict[str, int]:
        """Fill a new data folder and publish it, after the latest version's folders if ``keep_rows``."""
        versions = self.versions()
        last = versions[-1] if versions else 0
        kept = self.folders(last) if keep_rows and last else []
        name = f"data-{uuid.uuid4().hex}"
        try:
            counts = write_observed(df, f"{self.path}/{name}")
            self._commit(last + 1, [*kept, name])
        except Exception:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
            raise
        self._tidy()
        return counts

    def rollback(self) -> int:
        versions = self.versions()
        if len(versions) < 2:
            raise ValueError(f"{self.path}: no version before the latest")
        self._commit(versions[-1] + 1, self.folders(versions[-2]))
        return versions[-1] + 1

    def _commit(self, version: int, names: list[str]) -> None:
        staged = self._at(f"{self.path}/{COMMITS}/.{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray("\n".join(names).encode()))
        stream.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm_rename(), 0)
        try:
            files.rename(staged, self._at(f"{self.path}/{COMMITS}/{version:012d}"), none)
        except Py4JJavaError as failed:
            self._fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(failed.java_exception):
                raise CommitConflictError(f"{self.path}: version {version} is there already") from None
            raise

    def _jvm_rename(self):
        return getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")

    def _tidy(self) -> None:
        """Drop commits before the last ``KEEP``, and data folders only they list. Folders that no commit lists may be
        another writer's and stay."""
        versions = self.versions()
        old, kept = versions[:-KEEP], {name for v in versions[-KEEP:] for name in self.folders(v)}
        for name in {name for v in old for name in self.folders(v)} - kept:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        for v in old:
            self._fs.delete(self._at(f"{self.path}/{COMMITS}/{v:012d}"), False)


def write_observed(df: DataFrame, path: str) -> dict[str, int]:
    """Write Parquet and return ``rows`` plus ``nulls_<column>``, without a second pass."""
    seen = Observation()
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in df.columns]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("overwrite").parquet(path)
    return seen.get
