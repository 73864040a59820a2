"""From accepted ticks to index values: fan-out, stale gate, incremental value and level.

Ticks carry the order of application (``o1``, ``o2``). An index value is its base plus the sum of truncated changes, so
it depends on the path of prices, not only on the last ones. Running values are taken by blocks (``blocks.running``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import blocks


def in_order(ticks: DataFrame) -> DataFrame:
    """Ticks that need no gate, with their order of application."""
    return ticks.withColumn("o1", F.col("arrival")).withColumn("o2", F.lit(0).cast("bigint"))


def base_values(constituents: DataFrame) -> DataFrame:
    """Value at initial prices, divisor to a level of 1000, and the number of constituents with a weight, of each index."""
    value = F.sum(fixed.contribution(F.col("initial_price_e8"), F.col("weight_e8"))).cast("bigint")
    out = constituents.groupBy("index_id").agg(value.alias("base_e8"), F.count_if(F.col("weight_e8") > 0).cast("int").alias("constituent_count"))
    return out.select("index_id", "base_e8", (F.col("base_e8").cast("double") / fixed.BASE_LEVEL).alias("divisor"), "constituent_count")


def fan_out(ticks: DataFrame, constituents: DataFrame) -> DataFrame:
    """Each tick for each index that holds its instrument with a weight. Constituents are joined as their size allows: Spark broadcasts them only below its threshold."""
    held = constituents.where("weight_e8 <> 0").select("index_id", "instrument_id", "weight_e8", "initial_price_e8")
    return ticks.join(held, "instrument_id")


def fan_out_factor(ticks: DataFrame, constituents: DataFrame) -> DataFrame:
    """The number of indexes of each tick; 0 for an instrument that none holds."""
    routes = constituents.groupBy("instrument_id").agg(F.count("*").alias("routes"))
    return ticks.join(routes, "instrument_id", "left").withColumn("routes", F.coalesce("routes", F.lit(0)).cast("bigint"))


def stale_gate(ticks: DataFrame, by: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """``ticks`` with ``stale``: whether a tick is older than one that was applied before it.

    All indexes that hold an instrument see the same ticks of it, so one judgement an instrument holds for all of them,
    and ticks are judged before they are fanned out. Where indexes differ in what they have seen, as after a restore,
    ``by`` names the index as well.
    """
    out = blocks.running(ticks, list(by), {"__newest": (blocks.MAX, F.when(F.col("o1").isNotNull(), F.col("exchange_ts_nanos")))})
    newest = F.greatest(F.lit(0), F.coalesce("__newest", F.lit(0)))
    return out.withColumn("stale", F.col("exchange_ts_nanos") < newest).drop("__newest")


def previous_prices(ticks: DataFrame, by: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """``ticks`` with ``previous_e8``, the last price before a tick that is not stale; null if there is none."""
    return blocks.running(ticks, list(by), {"previous_e8": (blocks.LAST, F.when(~F.col("stale"), F.col("price_e8")))})


def changes(routed: DataFrame) -> DataFrame:
    """``routed`` (with ``stale`` and ``previous_e8``) with the change of value that each tick makes; a stale one makes none (null)."""
    moved = fixed.contribution(F.col("price_e8") - F.coalesce("previous_e8", "initial_price_e8"), F.col("weight_e8"))
    return routed.withColumn("delta_e8", F.when(~F.col("stale"), moved)).drop("previous_e8")


def judge(ticks: DataFrame, prevalidated: bool = False) -> DataFrame:
    """Applied ticks with ``stale`` and ``previous_e8``; prevalidated ones are never stale."""
    return previous_prices(ticks.withColumn("stale", F.lit(False)) if prevalidated else stale_gate(ticks))


def value_path(ticks: DataFrame, constituents: DataFrame, prevalidated: bool = False) -> DataFrame:
    """The value and level of each index after each tick that is applied to it."""
    fresh = changes(fan_out(judge(ticks, prevalidated).where("NOT stale"), constituents))
    sums = {"sum_e8": (blocks.SUM, F.col("delta_e8")), "index_sequence": (blocks.SUM, F.lit(1).cast("bigint"))}
    path = blocks.running(fresh, ["index_id"], sums, before=False)  # by the blocks that the ticks have
    value = F.col("base_e8") + F.col("sum_e8")
    out = path.join(base_values(constituents), "index_id").withColumn("value_e8", value.cast("bigint"))
    return out.select("index_id", F.col("index_sequence").alias("sequence"), "arrival", "instrument_id", "price_e8", "value_e8", fixed.level(F.col("value_e8"), F.col("divisor")).alias("level_e8"), F.col("receive_ts_nanos").alias("timestamp_nanos"), "constituent_count", "o1", "o2")


def latest_values(ticks: DataFrame, constituents: DataFrame, prevalidated: bool = False) -> DataFrame:
    """The last value and level of each index; an index that no tick touches keeps its base value, with sequence 0."""
    return judged_values(judge(ticks, prevalidated), constituents)


def judged_values(judged: DataFrame, constituents: DataFrame) -> DataFrame:
    """``latest_values`` of ticks that ``judge`` has judged: the last value needs only the sum of changes, which is aggregated before it is shuffled."""
    fresh = ~F.col("stale")
    moved = changes(fan_out(judged, constituents))
    totals = moved.groupBy("index_id").agg(F.sum("delta_e8").alias("sum_e8"), F.count_if(fresh).alias("sequence"), F.max_by("receive_ts_nanos", F.when(fresh, F.struct("o1", "o2"))).alias("timestamp_nanos"), F.count_if("stale").cast("int").alias("stale_constituent_count"))
    out = base_values(constituents).join(totals, "index_id", "left")
    out = out.withColumn("value_e8", (F.col("base_e8") + F.coalesce("sum_e8", F.lit(0))).cast("bigint"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("index_id", zero("sequence"), "value_e8", fixed.level(F.col("value_e8"), F.col("divisor")).alias("level_e8"), zero("timestamp_nanos"), "constituent_count", zero("stale_constituent_count"))


def recomputed_values(ticks: DataFrame, constituents: DataFrame) -> DataFrame:
    """The value of each index from its constituents' last prices; unlike the incremental value, it truncates each of them once."""
    last = ticks.groupBy("instrument_id").agg(F.max_by("price_e8", F.struct("o1", "o2")).alias("price_e8"))
    priced = constituents.join(last, "instrument_id", "left")
    price = F.coalesce("price_e8", "initial_price_e8")
    return priced.groupBy("index_id").agg(F.sum(fixed.contribution(price, F.col("weight_e8"))).cast("bigint").alias("value_e8"))


def tick_status(gated: DataFrame, constituents: DataFrame) -> DataFrame:
    """``gated`` with ``result``: each applied tick is ``applied``, or, if no index took it, ``stale`` (flagged so by the feed) or ``failed``; null for others."""
    placed = gated.withColumn("__applied", F.col("o1").isNotNull()).withColumn("o1", F.coalesce("o1", "arrival")).withColumn("o2", F.coalesce("o2", F.lit(0)))
    out = blocks.running(placed, ["instrument_id"], {"__newest": (blocks.MAX, F.when(F.col("__applied"), F.col("exchange_ts_nanos")))})
    held = constituents.where("weight_e8 <> 0").select("instrument_id").distinct().withColumn("__held", F.lit(True))
    took = F.col("__held").isNotNull() & (F.col("exchange_ts_nanos") >= F.greatest(F.lit(0), F.coalesce("__newest", F.lit(0))))
    status = F.when(took, "applied").when(fixed.is_stale(F.col("flags")), "stale").otherwise("failed")
    return out.join(held, "instrument_id", "left").withColumn("result", F.when(F.col("__applied"), status)).drop("__applied", "__newest", "__held")
