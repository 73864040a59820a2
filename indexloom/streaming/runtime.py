"""The running engine: ticks and actions in; deltas, snapshots and the metrics row out; and a start from snapshots.

Each micro-batch writes one file set a stream under its own number, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

import json
import time
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codec
from ..operators import gates, latest
from ..operators.metrics import SAMPLES
from . import engine, live, log, messages, meters

PROVIDER = "spark.sql.streaming.stateStore.providerClass"

SHUFFLE = "spark.sql.shuffle.partitions"

#: Partitions of state for each instrument at most: each costs every micro-batch two tasks with a store, rows or none.
STATES = 2

#: How often a micro-batch begins at most.
TRIGGER = "500 milliseconds"


@dataclass
class Publisher:
    """Writes each micro-batch's rows of ``live.live_values``. Deltas have one frame an index, snapshots and metrics are JSON."""

    root: str
    log_path: str
    plan: str
    partitions: int
    began: float = field(default_factory=time.monotonic)
    published: deque = field(default_factory=lambda: deque(maxlen=SAMPLES))

    def lag(self) -> int:
        """Offsets that the log has beyond the last micro-batch."""
        reader = log.TickLogReader({"path": self.log_path, "plan": self.plan, "partitions": str(self.partitions)})
        return sum(max(reader.end_of(p) - (reader.planned or {}).get(str(p), 0), 0) for p in range(self.partitions))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        began = time.perf_counter_ns()
        rows = batch.persist()  # a row an index; else each write would run the operators again
        try:
            live.delta_frames(rows).withColumn("offset", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{engine.stream_path(self.root, 'index.deltas')}/batch={number}")
            snapshots = live.snapshots_of(rows).withColumn("offset", F.lit(number))
            messages.to_messages(snapshots, "index_id", "offset").write.mode("overwrite").parquet(f"{engine.stream_path(self.root, 'index.snapshots')}/batch={number}")
            metered = rows.where(F.col("index_id") == live.ENGINE).select("meter").first()
        finally:
            rows.unpersist()
        self.published.append(time.perf_counter_ns() - began)
        if metered is not None:
            row = json.loads(metered.meter)
            elapsed = time.monotonic() - self.began
            row |= {"messages_per_second": row["messages_in"] / elapsed if elapsed > 0 else 0.0, "consumer_lag": self.lag(), "publication_duration_p99_nanos": meters.percentile(np.array(self.published), 0.99)}
            value = json.dumps({messages.camel(c): row[c] for c in meters.COLUMNS})
            spark.createDataFrame([("0", number, value)], "key string, offset bigint, value string").write.mode("overwrite").parquet(f"{engine.stream_path(self.root, 'engine.metrics')}/batch={number}")


def start(spark: SparkSession, root: str, log_path: str, checkpoint: str, actions: DataFrame, constituents: DataFrame, partitions: int, snapshots: DataFrame | None = None, policy: str = gates.BUFFER, rows: int = log.ROWS, segment: int = log.SEGMENT, rate: int = meters.SAMPLE_RATE, clock: int | None = None, trigger: str = TRIGGER) -> StreamingQuery:
    """Runs the engine over the log of ticks and a stream of actions. From ``snapshots`` (none: initial prices) it reads the log past
    the offsets that these name; a query that has a checkpoint already goes on from there instead, in its partitions of state."""
    starts: dict[int, int] = {}
    if snapshots is None:
        slots, values = live.first_slots(constituents), live.first_values(constituents)
    else:
        slots, values = live.restored_slots(snapshots), live.restored_values(snapshots)
        starts = dict(latest.replay_offsets(snapshots).collect())  # a row a partition
    frames = log.stream_log(spark, log_path, f"{checkpoint}/plan", partitions, rows, starts, segment)
    ticks = engine.decode_frames(frames).drop("frame")
    out = live.live_values(ticks, actions, constituents, slots, values, policy, rate=rate, clock=clock)
    publisher = Publisher(root, log_path, f"{checkpoint}/plan", partitions)
    spark.conf.set(PROVIDER, engine.ROCKSDB)  # the only store that the operators' kind of state can be kept in
    before = spark.conf.get(SHUFFLE)
    spark.conf.set(SHUFFLE, str(min(int(before), STATES * max(slots.select("instrument_id").distinct().count(), 1))))
    try:  # a query keeps the settings that it was started with
        return out.writeStream.foreachBatch(publisher).option("checkpointLocation", f"{checkpoint}/query").trigger(processingTime=trigger).start()
    finally:
        spark.conf.set(SHUFFLE, before)


def drain(query: StreamingQuery) -> None:
    """Lets a query read all that is there, and stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_deltas(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(batch, the columns of an index value) of published frames, as a batch or a stream."""
    reader = spark.readStream if stream else spark.read
    frames = reader.schema("key string, value binary, offset bigint, batch int").parquet(engine.stream_path(root, "index.deltas"))
    return frames.select(F.col("offset").alias("arrival"), codec.decode(F.col("value"), codec.INDEX_VALUE).alias("v")).select("arrival", "v.*")


def live_state(spark: SparkSession, root: str) -> DataFrame:
    """The last frame of each index."""
    return latest.latest_by_arrival(read_deltas(spark, root)).drop("arrival")


def read_metrics(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Published metrics rows with their batch (``offset``)."""
    return messages.from_messages(messages.read_messages(spark, root, "engine.metrics", stream), meters.SCHEMA).drop("key")


def last_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metrics row published last."""
    return read_metrics(spark, root).agg(F.max_by(F.struct(*meters.COLUMNS), "offset").alias("m")).where("m IS NOT NULL").select("m.*")
