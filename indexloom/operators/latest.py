"""Latest values, deltas, snapshots and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from . import gates, index_values


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def latest_by_sequence(values: DataFrame) -> DataFrame:
    """The row of the highest sequence of each index; later rows of a lower sequence never replace it."""
    return _last(values, "index_id", "sequence")


def latest_by_arrival(values: DataFrame) -> DataFrame:
    """The row that arrived last for each index, whatever its sequence."""
    return _last(values, "index_id", "arrival")


def upsert(stored: DataFrame, values: DataFrame) -> DataFrame:
    """``stored`` after a flush of ``values``: the last arrival of each index, put in only if its sequence is above the stored one."""
    news = latest_by_arrival(values).select(*stored.columns)
    both = stored.withColumn("new", F.lit(0)).unionByName(news.withColumn("new", F.lit(1)))
    # the stored row wins a tie
    rest = [c for c in stored.columns if c != "index_id"]
    return both.groupBy("index_id").agg(F.max_by(F.struct(*rest), F.struct("sequence", -F.col("new"))).alias("v")).select("index_id", "v.*").select(*stored.columns)


def every_n(path: DataFrame, n: int) -> DataFrame:
    """The last value of each index in every ``n`` arrivals: what a count trigger publishes."""
    bucket = path.withColumn("bucket", F.floor(F.col("o1") / n))
    rest = ["sequence", "value_e8", "level_e8", "timestamp_nanos"]
    return bucket.groupBy("bucket", "index_id").agg(F.max_by(F.struct(*rest), "sequence").alias("v")).select("bucket", "index_id", "v.*")


def snapshot(gated: DataFrame, constituents: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """The state of each index as parallel arrays in the order of instruments, with the last sequence of each instrument.

    ``gated`` has all ticks with their order of application; ``offsets`` (partition, offset) is what has been consumed. Ticks
    are summed up by slot in one pass; an index has few constituents, so its arrays are short.
    """
    held = constituents.select("index_id", "instrument_id", "weight_e8", "initial_price_e8")
    moved = index_values.changes(index_values.judge(gates.applied(gated)).join(held, "instrument_id"))
    counts = ~F.col("stale") & (F.col("weight_e8") != 0)
    place = F.when(counts, F.struct("o1", "o2"))
    by_slot = moved.groupBy("index_id", "instrument_id").agg(
        F.max_by("price_e8", place).alias("price"), F.max(F.when(counts, F.col("exchange_ts_nanos"))).alias("ts"), F.max("sequence").alias("last"),
        F.sum(F.when(counts, F.col("delta_e8"))).alias("sum_e8"), F.count_if(counts).alias("n"), F.max_by("receive_ts_nanos", place).alias("received"), F.max(place).alias("place"),
    )
    slot = F.struct("instrument_id", F.coalesce("price", "initial_price_e8").alias("price"), "weight_e8", F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("last", F.lit(-1)).alias("last"))
    arrays = held.join(by_slot, ["index_id", "instrument_id"], "left").groupBy("index_id").agg(F.array_sort(F.collect_list(slot)).alias("s"), F.sum("sum_e8").alias("sum_e8"), F.coalesce(F.sum("n"), F.lit(0)).alias("sequence"), F.coalesce(F.max_by("received", "place"), F.lit(0)).alias("timestamp_nanos"))
    out = arrays.join(index_values.base_values(constituents), "index_id").withColumn("value_e8", (F.col("base_e8") + F.coalesce("sum_e8", F.lit(0))).cast("bigint"))
    out = out.select("index_id", "sequence", "value_e8", "divisor", F.col("s.instrument_id").alias("instrument_ids"), F.col("s.price").alias("latest_prices_e8"), F.col("s.weight_e8").alias("weights_e8"), F.col("s.ts").alias("last_timestamp_nanos"), F.col("s.last").alias("last_sequences"), "timestamp_nanos")
    if offsets is None:
        return out.withColumn("partition_offsets", F.array().cast(T.ArrayType(T.LongType())))
    row = offsets.agg(F.transform(F.array_sort(F.collect_list(F.struct("partition", "offset"))), lambda x: x["offset"]).alias("partition_offsets"))
    return out.crossJoin(row)  # one row


def restored_values(snapshots: DataFrame, ticks: DataFrame) -> DataFrame:
    """The values of indexes after ``ticks`` (with their order of application, past those of the snapshot) on top of snapshots.

    Constituents are matched by instrument, and a tick counts if it is above the last sequence and not older than the
    last one applied.
    """
    slots = snapshots.select("index_id", F.inline(F.arrays_zip(F.col("instrument_ids").alias("instrument_id"), F.col("latest_prices_e8").alias("initial_price_e8"), F.col("weights_e8").alias("weight_e8"), F.col("last_timestamp_nanos").alias("last_ts"), F.col("last_sequences").alias("last_sequence"))))
    routed = ticks.join(slots.where("weight_e8 <> 0"), "instrument_id").where("sequence > last_sequence AND exchange_ts_nanos >= last_ts")
    by = ("index_id", "instrument_id")
    moved = index_values.changes(index_values.previous_prices(index_values.stale_gate(routed, by), by)).where("NOT stale").groupBy("index_id").agg(F.sum("delta_e8").alias("sum_e8"), F.count("*").alias("n"))
    out = snapshots.select("index_id", "sequence", "value_e8", "divisor").join(moved, "index_id", "left")
    out = out.withColumn("value_e8", (F.col("value_e8") + F.coalesce("sum_e8", F.lit(0))).cast("bigint")).withColumn("sequence", F.col("sequence") + F.coalesce("n", F.lit(0)))
    return out.select("index_id", "sequence", "value_e8", fixed.level(F.col("value_e8"), F.col("divisor")).alias("level_e8"))


def replay_offsets(snapshots: DataFrame) -> DataFrame:
    """Where reading starts again in each partition: past the least offset of 0 or more of any snapshot, else at the beginning (0)."""
    offsets = snapshots.select(F.posexplode("partition_offsets").alias("partition", "offset"))
    known = F.min(F.when(F.col("offset") >= 0, F.col("offset")))
    return offsets.groupBy("partition").agg(F.coalesce(known + 1, F.lit(0)).alias("start_offset"))


LAG_SCHEMA = "struct<topics:map<string,struct<partitions:map<string,struct<consumer_lag:bigint>>>>>"


def consumer_lag(statistics: DataFrame, topic: str) -> DataFrame:
    """``statistics`` (id, json) with the lag of a topic: the sum over its partitions, but for -1 and unknown lags."""
    parsed = F.from_json("json", LAG_SCHEMA)
    partitions = parsed["topics"][topic]["partitions"]
    lags = F.map_values(F.map_filter(F.coalesce(partitions, F.create_map().cast("map<string,struct<consumer_lag:bigint>>")), lambda k, v: (k != "-1") & (v["consumer_lag"] >= 0)))
    return statistics.select("id", F.aggregate(lags, F.lit(0).cast("bigint"), lambda a, v: a + v["consumer_lag"]).alias("consumer_lag"))
