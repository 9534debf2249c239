"""Registry of example queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Share out a text table that is a single file, whose one row group a single task would read and work on.

    A table of several files is read as it is.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


class Tables:
    """Lazy access to the tables of one directory: ``t.events`` reads events.parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


def demo(name: str, sql: str | None = None, **types: str):
    """Register a query and its SQL; ``types`` casts result columns of the SQL to the types Spark gives."""
    if sql and types:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return register
