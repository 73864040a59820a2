"""A keyed table in files: batches are merged into the buckets that they touch, and a pointer file says which files count.

A batch reads and writes only the buckets of its keys, beside what is there; then one small pointer file, written under
another name and moved, makes them the current ones. So a batch that fails leaves the table as it was, a batch that is run
again replaces itself, and folders that no pointer names any more are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import files_of

BUCKETS = 16

#: (stored rows, new rows) to what is stored then.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _pointers(self) -> list[str]:
        where, path = files_of(self.path)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".pointer"))

    def current(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        if not (pointers := self._pointers()):
            return {}
        with files_of(self.path)[0].open_input_stream(pointers[-1]) as f:
            return {int(b): folder for b, folder in json.loads(f.read()).items()}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for b, folder in self.current().items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, merge: Merge) -> None:
        """Merges a batch with a number of its own, which rises. The buckets that it touches are rewritten."""
        where, path = files_of(self.path)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
        before = self.current()
        if touched:
            columns = self.read().columns
            merged = merge(self.read(touched), batch).select(*columns)
            merged.withColumn("__bucket", bucket).repartition(len(touched), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/batch={number}")
        after = before | {b: f"batch={number}/__bucket={b}" for b in touched}
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/.writing") as f:
            f.write(json.dumps(after).encode())
        where.move(f"{path}/.writing", f"{path}/{number:012d}.pointer")
        self._clean(after)

    def _clean(self, kept: dict[int, str]) -> None:
        """Removes pointers but the last, and folders that it does not name."""
        where, path = files_of(self.path)
        for pointer in self._pointers()[:-1]:
            where.delete_file(pointer)
        for batch in where.get_file_info(fs.FileSelector(path)):
            if not batch.base_name.startswith("batch="):
                continue
            inner = [f for f in where.get_file_info(fs.FileSelector(batch.path)) if f.base_name.startswith("__bucket=")]
            stale = [f for f in inner if f"{batch.base_name}/{f.base_name}" not in kept.values()]
            for f in stale:
                where.delete_dir(f.path)
            if len(stale) == len(inner):
                where.delete_dir(batch.path)
