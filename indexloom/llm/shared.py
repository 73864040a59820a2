"""Binary files in the shared folder, written and read by tasks at any byte, on whatever store the folder's address names."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir

#: Bytes that one task of a scan owns.
SPLIT = 8 << 20

#: Tasks of a scan at most.
RANGES = 1 << 15


def new_folder(spark: SparkSession, what: str) -> str:
    """The address of a folder of its own below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` written once as Parquet in the shared folder: columns that repeat take little room, and later readers take only those that they need."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def store(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (a path, or a URI such as file:, hdfs: or s3:) and the path in it."""
    if (local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", address)) is not None:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(address)


def task_file(number: int, suffix: str) -> str:
    """A name that no other task and no other attempt of this one uses; what a lost attempt has left is in no manifest."""
    task = TaskContext.get()
    return f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}{suffix}"


def byte_ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, stop) of ranges of at most ``split`` bytes, dealt over as many tasks as there are ranges (at most RANGES);
    ``files`` has path and size, and is written already."""
    found = files.where("size > 0")
    n = found.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start")
    ranges = found.select("path", starts, "size").select("path", "start", F.least(F.col("start") + split, "size").alias("stop"))
    return ranges.repartition(min(int(n), RANGES), "path", "start")
