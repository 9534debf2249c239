"""Immutable table versions behind an active pointer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(Exception):
    """The active version is not the one the new version was built on."""


def write_checked(df: DataFrame, path: str, version: int, validate: Callable[[DataFrame], DataFrame]) -> None:
    """Write ``df`` as the partition ``version`` of a table unless ``validate`` returns violations of its rows; an existing one stays."""
    problems = validate(df).count()
    if problems:
        raise ValueError(f"version {version} refused: {problems} violations")
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


class VersionedTable:
    """A folder with ``version=<id>`` data and an append-only pointer log.

    A version is written first and only then made active by one appended pointer row, so a failed
    validation or a lost executor leaves the active version as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_active")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        return self.spark.read.schema("seq LONG, version STRING, action STRING").json(f"{self.path}/_active")

    def history(self) -> list[tuple[int, str, str]]:
        """Pointer log in order; one row per commit."""
        log = self._pointers()
        return [] if log is None else [tuple(r) for r in log.orderBy("seq").collect()]

    def active(self) -> str | None:
        log = self.history()
        return log[-1][1] if log else None

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version or self.active()}")

    def commit(self, df: DataFrame, version: str, validate: Callable[[DataFrame], DataFrame], *, based_on: str | None = None) -> str:
        """Write a version, check it, then make it active.

        ``validate`` returns one row per violation; any violation refuses the version.  ``based_on`` must
        be the active version (none for the first one).
        """
        if self.active() != based_on:
            raise VersionConflict(f"active version is {self.active()}, not {based_on}")
        df.write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self._activate(version, validate, "commit", based_on)

    def rollback(self, version: str, validate: Callable[[DataFrame], DataFrame]) -> str:
        """Make an older version active again after the same checks."""
        return self._activate(version, validate, "rollback", self.active())

    def _activate(self, version: str, validate, action: str, based_on: str | None) -> str:
        problems = validate(self.read(version))
        if not problems.isEmpty():
            raise ValueError(f"version {version} refused: {problems.count()} violations")
        if self.active() != based_on:
            raise VersionConflict(f"active version is {self.active()}, not {based_on}")
        seq = len(self.history()) + 1
        row = self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(version).alias("version"), F.lit(action).alias("action"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/_active")
        return version
