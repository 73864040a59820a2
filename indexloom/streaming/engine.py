"""Streams of ticks: frames in, gated ticks, latest values and dead letters out.

The sequence gate keeps its state (last sequence, waiting ticks) in the state store, by instrument. Sinks write each
micro-batch under its number, so a batch that is run again replaces what it wrote and nothing is counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import codec
from ..operators import gates, latest
from . import messages, tables
from .messages import STREAMS, stream_path  # noqa: F401

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def write_frames(ticks: DataFrame, root: str) -> None:
    """Ticks as 47-byte frames with their partition and offset (arrival), appended to the raw stream."""
    ticks.select("partition", F.col("arrival").alias("offset"), codec.encode(codec.TICK).alias("value")).write.mode("append").parquet(stream_path(root, "ticks.raw"))


def read_frames(spark: SparkSession, root: str, max_files: int = 1) -> DataFrame:
    frames = spark.readStream.schema("partition int, offset bigint, value binary").option("maxFilesPerTrigger", max_files).parquet(stream_path(root, "ticks.raw"))
    return decode_frames(frames)


def decode_frames(frames: DataFrame) -> DataFrame:
    """Ticks with ``arrival``; a frame that is short or names no instrument has instrument_id null or 0."""
    return frames.select(F.col("offset").alias("arrival"), F.col("value").alias("frame"), codec.decode(F.col("value"), codec.TICK).alias("t")).select("arrival", "frame", "t.*")


def split_dead_letters(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks, dead letters)."""
    dead = F.coalesce(F.col("instrument_id"), F.lit(0)) == 0
    return decoded.where(~dead).drop("frame"), decoded.where(dead).select("arrival", "frame")


class _GateProcessor(StatefulProcessor):
    def __init__(self, policy: str, capacity: int, columns: list[str]):
        self.policy, self.capacity, self.columns = policy, capacity, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "last bigint, waiting string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        gate = gates.Gate(self.policy, self.capacity)
        if (kept := self.state.get()) is not None:
            gate.last = kept[0]
            held = json.loads(kept[1])
            gate.waiting = {t["sequence"]: i for i, t in enumerate(held)}
        ticks = held + sorted((t for pdf in rows for t in pdf.to_dict("records")), key=lambda t: t["arrival"])
        out = [r for i in range(len(held), len(ticks)) for r in gate.accept(i, int(ticks[i]["sequence"]), int(ticks[i]["arrival"]))]
        waiting = [{c: int(ticks[i][c]) for c in self.columns} for i in gate.waiting.values()]
        self.state.update((gate.last, json.dumps(waiting)))
        yield pd.DataFrame([{**{c: ticks[r.row][c] for c in self.columns}, "status": r.status, "o1": r.o1, "o2": r.o2} for r in out], columns=[*self.columns, "status", "o1", "o2"]).astype({"o1": "Int64", "o2": "Int64"})

    def close(self) -> None:
        pass


def gate_stream(ticks: DataFrame, policy: str = gates.BUFFER, capacity: int = gates.CAPACITY) -> DataFrame:
    """Gated ticks of a stream, with statuses as ``gates.gate`` gives; ticks that wait come out when their hole is filled. All columns are integers."""
    schema = T.StructType([*ticks.schema.fields, T.StructField("status", T.StringType()), T.StructField("o1", T.LongType()), T.StructField("o2", T.LongType())])
    processor = _GateProcessor(policy, capacity, ticks.columns)
    return ticks.groupBy("instrument_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def append_batches(stream: DataFrame, root: str, name: str, checkpoint: str):
    """A query that writes each micro-batch of a stream to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stream_path(root, name)}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def keep_latest(values: DataFrame, path: str, checkpoint: str):
    """A query that keeps, for each index, the row of the highest sequence in a ``tables.KeyedTable``, whose columns are those of ``values`` without ``arrival``."""
    schema = T.StructType([f for f in values.schema.fields if f.name != "arrival"])

    def write(batch: DataFrame, number: int) -> None:
        table = tables.KeyedTable(batch.sparkSession, path, "index_id", schema)
        batch = batch.persist()
        try:
            table.merge(batch, number, latest.upsert)
        finally:
            batch.unpersist()

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def publish_actions(actions: DataFrame, root: str) -> None:
    """Corporate actions as JSON messages (by index, at the place where they take effect), to their stream and to the audit log."""
    fields = [F.col(c).alias(messages.camel(c)) for c in ("index_id", "instrument_id", "type", "new_weight_e8")]
    rows = actions.select(F.col("index_id").cast("string").alias("key"), F.col("o1").alias("offset"), F.to_json(F.struct(*fields)).alias("value"))
    for name in ("corporate.actions", "index.audit"):
        rows.write.mode("append").parquet(stream_path(root, name))
