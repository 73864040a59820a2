"""Rows written once to the folder that all executors share, so that what follows neither plans nor computes them again."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Set while a cut runs: its shuffle files go when its rows are written, not when the driver next collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster has to name one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        path = _local_folder()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, with their lineage cut and their shuffle files deleted.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes the written rows when no frame refers to them.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame of its own, which is made under that setting
    finally:
        spark.conf.set(FILE_CLEANUP, before)
