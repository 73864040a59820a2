"""Counters, percentiles, throughput and alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK
from .durable import cut

#: Percentiles are taken over this many last samples.
SAMPLES = 16_384
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def last_rows(df: DataFrame, by: list[str], order: str, n: int, block: int = BLOCK) -> DataFrame:
    """The last ``n`` rows of each key by an integer column that orders them. Counts by key and block say in which block the
    last ``n`` begin; later ones are taken whole, and only that block's rows are ranked. Runs one job, whose result has a row a key and block."""
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    counts = cut(rows.groupBy(*by, "__block").agg(F.count("*").alias("__n")))
    after = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("__later", F.coalesce(F.sum("__n").over(after), F.lit(0))).where(F.col("__later") < n).withColumn("__cut", F.col("__later") + F.col("__n") > n)
    kept = rows.join(later.select(*by, "__block", "__later", "__cut"), [*by, "__block"])
    ranked = kept.where("__cut").withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__block").orderBy(F.desc(order))))
    begun = ranked.where(F.col("__later") + F.col("__place") <= n).select(*df.columns)
    return kept.where("NOT __cut").select(*df.columns).unionByName(begun)


def percentiles(df: DataFrame, value: Column, order: Column, by: list[str] | None = None, samples: int = SAMPLES, wanted: dict[str, float] = PERCENTILES, block: int = BLOCK) -> DataFrame:
    """Nearest-rank percentiles of the last samples of each key (of all rows without keys); values below 0 count as 0.

    Without keys the last samples come from a top-k, with keys from ``last_rows``; each key's percentiles are of ``samples`` rows at most.
    """
    keys = by or []
    rows = df.select(*keys, F.greatest(value, F.lit(0)).alias("__v"), order.alias("__o"))
    last = last_rows(rows, keys, "__o", samples, block) if keys else rows.orderBy(F.desc("__o")).limit(samples)
    out = [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __v)").cast("bigint"), F.lit(0)).alias(name) for name, p in wanted.items()]
    return last.groupBy(*keys).agg(F.count("*").alias("samples"), *out)


def counters(statuses: DataFrame) -> DataFrame:
    """One row of the engine's counters. ``statuses`` has all ticks with ``status`` of the gate and ``result`` of the calculation.

    Dropped ticks (instrument 0) and flagged stale ticks go to the dead letters; ``unresolved`` is in less out.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status, result = F.col("status"), F.col("result")
    real = F.col("instrument_id") != 0
    out = statuses.agg(
        n(real).alias("messages_in"),
        n(real & (result == "applied")).alias("messages_out"),
        n(~real).alias("dropped"),
        n(real & (result == "stale")).alias("stale"),
        n(real & (status == "duplicate")).alias("duplicates"),
        n(real & status.isin("gap", "dropped", "full", "recovered", "pending")).alias("sequence_gaps"),
        n(real & ((result == "failed") | (status == "full"))).alias("calculation_failures"),
    )
    return out.withColumn("dead_letters", F.col("dropped") + F.col("stale")).withColumn("unresolved", F.col("messages_in") - F.col("messages_out"))


def throughput(ticks: DataFrame, ts_nanos: str = "receive_ts_nanos") -> DataFrame:
    """Ticks, the seconds that they span, and ticks a second (0 for no span)."""
    out = ticks.agg(F.count("*").alias("messages"), ((F.max(ts_nanos) - F.min(ts_nanos)).cast("double") / 1e9).alias("seconds"))
    return out.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("messages") / F.col("seconds")).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class Alarm:
    """Breached when a period's statistic (max or sum) is above the threshold in ``periods`` periods running."""

    name: str
    metric: str
    statistic: str
    seconds: int
    periods: int
    threshold: float


RING_SIZE = 65_536

# Alarms of production.
ALARMS = [
    Alarm("e2e-p99", "e2e_nanos", "max", 60, 3, 40_000_000),
    Alarm("processing-p99", "processing_nanos", "max", 60, 2, 5_000_000),
    Alarm("consumer-lag", "consumer_lag", "max", 60, 2, 10_000),
    Alarm("ring-depth", "ring_depth", "max", 60, 3, RING_SIZE // 2),
    Alarm("sequence-gaps", "sequence_gaps", "sum", 300, 1, 0),
    Alarm("duplicates", "duplicates", "sum", 300, 1, 100),
    Alarm("calculation-failures", "calculation_failures", "sum", 300, 1, 0),
    Alarm("dropped", "dropped", "sum", 60, 1, 0),
    Alarm("stale-rate", "stale_percent", "rate", 300, 2, 1.0),
    Alarm("publisher-lag", "publisher_lag", "max", 60, 3, 5_000),
]


def alarm_states(points: DataFrame, alarm: Alarm, ts_micros: str, value: Column, of: Column | None = None) -> DataFrame:
    """(period, value, breaching, alarm) of every period with points. ``of`` is what a rate is a percentage of.

    Periods without points do not breach, so only neighbouring periods make a run.
    """
    period = F.floor(F.col(ts_micros) / (alarm.seconds * 1_000_000)).alias("period")
    if alarm.statistic == "rate":
        total = F.sum(of)
        statistic = F.when(total > 0, F.sum(value) * 100.0 / total).otherwise(F.lit(0.0))
    else:
        statistic = (F.max if alarm.statistic == "max" else F.sum)(value).cast("double")
    out = points.groupBy(period).agg(statistic.alias("value")).withColumn("breaching", F.col("value") > alarm.threshold)
    # a breach counts for its own and the next periods; a period with as many breaches as it looks back on is in alarm
    reach = F.explode(F.sequence(F.col("period"), F.col("period") + (alarm.periods - 1))).alias("period")
    runs = out.where("breaching").select(reach).groupBy("period").agg(F.count("*").alias("n"))
    return out.join(runs, "period", "left").select("period", "value", "breaching", (F.coalesce("n", F.lit(0)) >= alarm.periods).alias("alarm"))
