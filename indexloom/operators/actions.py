"""Corporate actions: changes, additions and removals of weights that leave the level where it was.

Actions and ticks are ordered together: an action takes effect before the ticks whose ``o1`` is above its own. Actions
are few, so what depends on their history (weights, divisors) is folded over them alone, for each index; the value of an
index stays a sum of changes over ticks and actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import blocks
from .index_values import base_values

CHANGE, ADDITION, REMOVAL = "WeightChange", "ConstituentAddition", "ConstituentRemoval"

ACTION_SCHEMA = "o1 bigint, index_id smallint, instrument_id int, type string, new_weight_e8 bigint"


def weight_history(actions: DataFrame, constituents: DataFrame) -> DataFrame:
    """Actions that take effect, with the weight before and after. Additions count only at weight 0, and unknown constituents or types never.

    Changes and removals always count, so each sets the weight of a slot anew, whatever came before. After one (or at the
    start), additions count if it left weight 0 and no addition of another weight has counted since: a matter of running
    values, so no slot's actions are gathered.
    """
    known = actions.join(constituents.select("index_id", "instrument_id", "weight_e8"), ["index_id", "instrument_id"]).where(F.col("type").isin(CHANGE, ADDITION, REMOVAL))
    ordered = known.select("index_id", "instrument_id", "weight_e8", "o1", F.struct("type", "new_weight_e8").alias("o2"), "type", F.when(F.col("type") == REMOVAL, F.lit(0).cast("bigint")).otherwise(F.col("new_weight_e8")).alias("w_after"))
    by, adds = ["index_id", "instrument_id"], F.col("type") == ADDITION
    counted = blocks.running(blocks.in_blocks(ordered), by, {"set_to": (blocks.LAST, F.when(~adds, F.col("w_after"))), "added": (blocks.SUM, (adds & (F.col("w_after") != 0)).cast("bigint"))})
    since = blocks.running(counted, by, {"added_then": (blocks.LAST, F.when(~adds, F.col("added")))})
    open_ = (F.coalesce("set_to", "weight_e8") == 0) & (F.col("added") == F.coalesce("added_then", F.lit(0)))
    effective = since.where(~adds | open_)
    before = blocks.running(effective, by, {"w_last": (blocks.LAST, F.col("w_after"))})
    return before.select("index_id", "instrument_id", "o1", "type", F.coalesce("w_last", "weight_e8").alias("w_before"), "w_after")


def path(ticks: DataFrame, constituents: DataFrame, actions: DataFrame) -> DataFrame:
    """Ticks and actions of each index in order, with the change of value that each one makes and the weight in force."""
    history = weight_history(actions, constituents)
    held = constituents.select("index_id", "instrument_id", "weight_e8", "initial_price_e8")
    none = F.lit(None)
    of_ticks = ticks.select("instrument_id", "o1", "o2", "price_e8", "exchange_ts_nanos", none.cast("string").alias("type"), none.cast("bigint").alias("w_before"), none.cast("bigint").alias("w_after")).join(held, "instrument_id")
    of_actions = history.join(held, ["index_id", "instrument_id"]).select("instrument_id", "o1", F.lit(-1).cast("bigint").alias("o2"), none.cast("bigint").alias("price_e8"), none.cast("bigint").alias("exchange_ts_nanos"), "type", "w_before", "w_after", "index_id", "weight_e8", "initial_price_e8")
    both = of_ticks.unionByName(of_actions)
    by = ["index_id", "instrument_id"]
    is_tick, is_action = F.col("type").isNull(), F.col("type").isNotNull()
    weighed = blocks.running(both, by, {"w_last": (blocks.LAST, F.col("w_after"))}).withColumn("w", F.coalesce("w_before", "w_last", "weight_e8")).where(is_action | (F.col("w") != 0))
    aged = blocks.running(weighed, by, {"newest": (blocks.MAX, F.col("exchange_ts_nanos"))})
    fresh = aged.where(is_action | (F.col("exchange_ts_nanos") >= F.greatest(F.lit(0), F.coalesce("newest", F.lit(0)))))
    moved = blocks.running(fresh, by, {"last_price": (blocks.LAST, F.col("price_e8"))}).withColumn("previous", F.coalesce("last_price", "initial_price_e8"))
    tick = fixed.contribution(F.col("price_e8") - F.col("previous"), F.col("w"))
    action = fixed.contribution(F.col("previous"), F.col("w_after")) - fixed.contribution(F.col("previous"), F.col("w_before"))
    count = F.when(F.col("type") == ADDITION, 1).when(F.col("type") == REMOVAL, -1).otherwise(0)
    return moved.select("index_id", "instrument_id", "o1", "o2", "type", "w_before", "w_after", F.coalesce(F.when(is_tick, tick).otherwise(action), F.lit(0)).cast("bigint").alias("delta_e8"), count.cast("bigint").alias("count_change"))


def values_after_actions(ticks: DataFrame, constituents: DataFrame, actions: DataFrame) -> DataFrame:
    """The last value, divisor, level, sequence and number of constituents of each index.

    Value before an action is the base and the changes up to it; these sums are taken for spans between actions, so
    only one row for each action and index is put in order.
    """
    rows = path(ticks, constituents, actions)
    numbered = blocks.running(rows, ["index_id"], {"span": (blocks.SUM, F.col("type").isNotNull().cast("bigint"))}, before=False)
    sums = numbered.groupBy("index_id", "span").agg(F.sum(F.when(F.col("type").isNull(), F.col("delta_e8")).otherwise(0)).alias("ticks_e8"), F.sum(F.when(F.col("type").isNotNull(), F.col("delta_e8"))).alias("action_e8"), F.sum("count_change").alias("count_change"), F.count("*").alias("n"))
    ordered = sums.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("span", "ticks_e8", "action_e8", "count_change", "n"))).alias("spans"))
    start = F.struct(F.col("base_e8").alias("v"), F.col("divisor").alias("d"), F.col("constituent_count").cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("s"))

    def step(state, x):
        after = state["v"] + F.coalesce(x["action_e8"], F.lit(0))
        moved = F.when(state["v"] > 0, after.cast("double") * state["d"] / state["v"].cast("double")).otherwise(after.cast("double") / fixed.BASE_LEVEL)
        divisor = F.when(x["action_e8"].isNull(), state["d"]).otherwise(moved)
        return F.struct((after + x["ticks_e8"]).cast("bigint").alias("v"), divisor.alias("d"), (state["c"] + x["count_change"]).alias("c"), (state["s"] + x["n"]).alias("s"))

    folded = base_values(constituents).join(ordered, "index_id", "left").select("index_id", F.aggregate(F.coalesce("spans", F.array().cast(ordered.schema["spans"].dataType)), start, step).alias("x"))
    return folded.select("index_id", F.col("x.s").alias("sequence"), F.col("x.v").alias("value_e8"), F.col("x.d").alias("divisor"), fixed.level(F.col("x.v"), F.col("x.d")).alias("level_e8"), F.col("x.c").alias("constituent_count"))
