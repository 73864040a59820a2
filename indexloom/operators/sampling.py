"""Which batches have their latency sampled: those at which a running count of ticks reaches a rate, and starts anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut

#: Batches that one step table spans.
BATCHES = 1 << 14


def sampled_batches(sizes: DataFrame, rate: int, block: int = BATCHES) -> DataFrame:
    """``sizes`` (batch, n; batch is an integer that orders them) with ``sampled``. Nothing is for a rate of 0.

    The count before a batch is below the rate, so a block of batches is a table of ``rate`` entries: from the count before it to
    the one after. These are found for all blocks at once, run through in order, and each block then starts from its own count.
    """
    if rate <= 0:
        return sizes.withColumn("sampled", F.lit(False))
    blocked = sizes.select(F.call_function("div", "batch", F.lit(block)).alias("__block"), "batch", F.col("n").cast("bigint").alias("n"))

    def step(counts: np.ndarray, n: int) -> np.ndarray:
        counts = counts + n
        return np.where(counts >= rate, 0, counts)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([table], pa.list_(pa.int64()))], names=["__block", "table"])
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        yield out()
                    key, table = own, np.arange(rate)
                table = step(table, n)
        if key is not None:
            yield out()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            begun = []
            for table in batch.column(1).to_pylist():
                begun.append(count)
                count = table[count]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begun, pa.int64())], names=["__block", "start"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, 0
        for batch in batches:
            sampled = []
            for own, n, start in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if own != key:
                    key, count = own, start
                count += n
                sampled.append(count >= rate)
                count = 0 if sampled[-1] else count
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sampled)], names=["batch", "n", "sampled"])

    ordered = blocked.repartition("__block").sortWithinPartitions("__block", "batch")
    found = ordered.mapInArrow(tables, "__block bigint, table array<bigint>")
    begun = cut(found.coalesce(1).sortWithinPartitions("__block").mapInArrow(starts, "__block bigint, start bigint"))  # a row a block
    return blocked.join(begun, "__block").repartition("__block").sortWithinPartitions("__block", "batch").mapInArrow(decide, "batch bigint, n bigint, sampled boolean")


def batch_samples(gated: DataFrame, batch: str, rate: int, order: str = "arrival") -> DataFrame:
    """Of each sampled batch the first tick that its gate let pass when it arrived; a batch without one has no sample.

    ``gated`` has all ticks with ``status`` of the gate and the integer ``batch`` that brought each.
    """
    passed = F.col("status").isin("accepted", "gap")
    rest = [c for c in gated.columns if c != batch]
    by_batch = gated.groupBy(F.col(batch).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.min_by(F.struct(*rest), F.when(passed, F.col(order))).alias("first"))
    sampled = sampled_batches(by_batch.select("batch", "n"), rate).where("sampled").select("batch")
    return by_batch.where("first IS NOT NULL").join(sampled, "batch").select("batch", "first.*")
