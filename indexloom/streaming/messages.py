"""JSON messages of the engine's streams: snapshots, corporate actions and metrics, in and out, and what a restart reads.

Messages are rows (key, offset, value) in the folders of ``stream_path``; ``value`` is a JSON object with names in
camel case. Everything is a column expression, so that the same functions serve batches and streams.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import latest

#: Names of the streams of the engine; each is a folder of files below a root.
STREAMS = ["ticks.raw", "ticks.normalized", "index.deltas", "index.snapshots", "engine.metrics", "corporate.actions", "index.audit", "dlq.events"]


def stream_path(root: str, name: str) -> str:
    if name not in STREAMS:
        raise ValueError(f"no stream is named {name}")
    return f"{root}/{name}"


SNAPSHOT_SCHEMA = "index_id smallint, sequence bigint, value_e8 bigint, divisor double, instrument_ids array<int>, latest_prices_e8 array<bigint>, weights_e8 array<bigint>, last_timestamp_nanos array<bigint>, last_sequences array<bigint>, timestamp_nanos bigint, partition_offsets array<bigint>"
ACTION_SCHEMA = "index_id smallint, instrument_id int, type string, new_weight_e8 bigint"


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def to_messages(rows: DataFrame, key: str | None, offset: str) -> DataFrame:
    """(key, offset, value): each row as JSON, without the column of its offset."""
    fields = [F.col(c).alias(camel(c)) for c in rows.columns if c != offset]
    return rows.select((F.lit("0") if key is None else F.col(key).cast("string")).alias("key"), F.col(offset).cast("bigint").alias("offset"), F.to_json(F.struct(*fields)).alias("value"))


def from_messages(messages: DataFrame, schema: str) -> DataFrame:
    """key, offset and the fields of ``schema``; a value that is no such JSON has them null."""
    names = [f.split()[0] for f in re.split(r", (?=\w+ )", schema)]
    wire = ", ".join(f"{camel(n)} {f.split(' ', 1)[1]}" for n, f in zip(names, re.split(r", (?=\w+ )", schema), strict=True))
    return messages.select("key", "offset", F.from_json("value", wire).alias("m")).select("key", "offset", *[F.col(f"m.{camel(n)}").alias(n) for n in names])


def write_messages(messages: DataFrame, root: str, name: str) -> None:
    messages.write.mode("append").parquet(stream_path(root, name))


def read_messages(spark: SparkSession, root: str, name: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema("key string, offset bigint, value string").parquet(stream_path(root, name))


def last_messages(messages: DataFrame) -> DataFrame:
    """The last message of each key: what a compacted topic holds."""
    return messages.groupBy("key").agg(F.max_by(F.struct("offset", "value"), "offset").alias("m")).select("key", "m.*")


def write_snapshots(snapshots: DataFrame, root: str, number: int) -> None:
    write_messages(to_messages(snapshots.withColumn("offset", F.lit(number)), "index_id", "offset"), root, "index.snapshots")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The last snapshot of each index; one that cannot be read is left out."""
    rows = from_messages(last_messages(read_messages(spark, root, "index.snapshots")), SNAPSHOT_SCHEMA)
    return rows.where(F.col("index_id").isNotNull()).drop("key", "offset")


def replayed(ticks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Those of ``ticks`` (with partition and arrival as their offset) that a restart from ``snapshots`` reads; all of a partition that no snapshot knows."""
    start = latest.replay_offsets(snapshots)
    return ticks.join(start, "partition", "left").where(F.col("arrival") >= F.coalesce("start_offset", F.lit(0))).drop("start_offset")


def read_actions(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Corporate actions as published (``engine.publish_actions``), with their place ``o1``, as a batch or a stream; an unreadable message has nulls."""
    return from_messages(read_messages(spark, root, "corporate.actions", stream), ACTION_SCHEMA).drop("key").withColumnRenamed("offset", "o1")


def latency_measures(ticks: DataFrame, now_nanos: F.Column) -> DataFrame:
    """``ticks`` with the nanoseconds since they were received and, where the exchange gave a time, since it did; none below 0."""
    since = lambda c: F.greatest(now_nanos - F.col(c), F.lit(0))
    return ticks.withColumn("processing_nanos", since("receive_ts_nanos")).withColumn("e2e_nanos", F.when(F.col("exchange_ts_nanos") > 0, since("exchange_ts_nanos")))


def latency_samples(ticks: DataFrame, rate: int, order: str = "arrival") -> DataFrame:
    """Every ``rate``-th tick by its place in the order of arrival."""
    return ticks.where(F.col(order) % rate == 0)


def checkpoint_state(query: StreamingQuery, now_millis: int) -> dict[str, int | None]:
    """Age of a stream's last committed batch in milliseconds (None if there is none), its duration, and the rows and bytes of its state."""
    progress = query.lastProgress
    if progress is None:
        return {"age_millis": None, "duration_millis": None, "state_rows": 0, "state_bytes": 0}
    from datetime import datetime

    at = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp() * 1000
    state = progress["stateOperators"]
    return {
        "age_millis": max(int(now_millis - at), 0),
        "duration_millis": progress["durationMs"].get("triggerExecution"),
        "state_rows": sum(s["numRowsTotal"] for s in state),
        "state_bytes": sum(s["memoryUsedBytes"] for s in state),
    }
