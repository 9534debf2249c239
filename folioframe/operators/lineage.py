"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` or set with ``setCheckpointDir``.

    Only a local session may leave it unset; it then works beside its own tables, in the warehouse folder.  A cluster has
    to name a folder that the driver and all executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    return f"{work_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that losing executors does not undo it.

    A written table starts with a clean plan, without what the optimizer had derived for the old one.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Empty the table behind a result of ``cut_lineage`` that nothing reads any more."""
    path = df.inputFiles()
    if path:
        df.limit(0).write.mode("overwrite").parquet(path[0].rpartition("/")[0])
