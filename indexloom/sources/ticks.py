"""Ticks from a table of events, clean or with faults put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import blocks

N_INSTRUMENTS = 8
PARTITIONS = 4
HOURS_3 = 3 * 3600 * 1_000_000_000

# Exchanges of event types; other types are exchange 5.
EXCHANGES = {"click": 1, "error": 2, "purchase": 3, "signup": 4}

COLUMNS = ["arrival", "sequence", "instrument_id", "exchange_id", "price_e8", "quantity", "exchange_ts_nanos", "receive_ts_nanos", "partition", "flags"]


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick an event, without its sequence: a projection of the table. ``arrival`` orders all ticks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    instrument = (F.col("user_id") % N_INSTRUMENTS + 1).cast("int")
    exchange = F.lit(5)
    for kind, n in EXCHANGES.items():
        exchange = F.when(F.col("event_type") == kind, n).otherwise(exchange)
    wall = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))  # the wall clock, whatever the session's zone
    return events.select(
        (F.col("event_id") * 4).alias("arrival"),
        instrument.alias("instrument_id"),
        exchange.cast("smallint").alias("exchange_id"),
        fixed.to_scaled(F.col("value")).alias("price_e8"),
        F.get_json_object("props", "$.k").cast("int").alias("quantity"),
        (wall * 1000).alias("exchange_ts_nanos"),
        (wall * 1000 + 1000).alias("receive_ts_nanos"),
        fixed.route(instrument, PARTITIONS).alias("partition"),
        F.lit(fixed.TRADE).cast("tinyint").alias("flags"),
    )


def clean_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_ticks`` with ``sequence``, which counts the ticks of an instrument."""
    ordered = raw_ticks(spark, sf_dir).select("*", F.col("arrival").alias("o1"), F.lit(0).alias("o2"))
    counted = blocks.running(ordered, ["instrument_id"], {"sequence": (blocks.SUM, F.lit(1).cast("bigint"))}, before=False)
    return counted.select(*COLUMNS)


def faulty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean ticks, of which some are lost, late, sent again, or have an old time (flagged or not)."""
    event = (F.col("arrival") / 4).cast("bigint")
    ticks = clean_ticks(spark, sf_dir).withColumn("event", event).where("event % 53 <> 0")
    old = F.col("event") % 41 == 0
    ticks = ticks.withColumn("exchange_ts_nanos", F.when(old, F.col("exchange_ts_nanos") - HOURS_3).otherwise(F.col("exchange_ts_nanos")))
    ticks = ticks.withColumn("flags", F.when(old & (F.col("event") % 2 == 0), fixed.TRADE | fixed.STALE).otherwise(fixed.TRADE).cast("tinyint"))
    late = F.when(F.col("event") % 31 == 0, (F.col("event") + 40) * 4 + 1).otherwise(F.col("arrival"))
    arrivals = F.when(F.col("event") % 97 == 0, F.array(late, F.col("event") * 4 + 2)).otherwise(F.array(late))  # the second is the tick sent again
    return ticks.withColumn("arrival", F.explode(arrivals)).select(*COLUMNS)
