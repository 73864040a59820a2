"""Alarms over a stream: a statistic of each period, and how many periods running it has been breached.

Periods are tumbling windows of event time, closed by a watermark; what comes later than ``delay`` is left out. The run of
breaches is kept by alarm; a period without points ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import Alarm

DELAY = "1 minute"

_STATE = Row("name", "period", "value", "breaching", "alarm")


class _Runs(StatefulProcessor):
    """The last period of an alarm and its run of breaches."""

    def __init__(self, periods: int):
        self.periods = periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "period bigint, length bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, length = self.run.get() or (None, 0)
        for r in sorted(rows, key=lambda r: r.period):
            length = 0 if not r.breaching else length + 1 if last is not None and r.period == last + 1 else 1
            last = r.period
            yield _STATE(key[0], r.period, r.value, r.breaching, length >= self.periods)
        self.run.update((last, length))

    def close(self) -> None:
        pass


def alarm_stream(points: DataFrame, alarm: Alarm, ts_micros: str, value: Column, of: Column | None = None, delay: str = DELAY) -> DataFrame:
    """(name, period, value, breaching, alarm) of each closed period, as ``metrics.alarm_states`` gives them for a table."""
    timed = points.select(F.timestamp_micros(F.col(ts_micros)).alias("at"), value.alias("value"), (F.lit(1) if of is None else of).alias("of")).withWatermark("at", delay)
    if alarm.statistic == "rate":
        statistic = F.when(F.sum("of") > 0, F.sum("value") * 100.0 / F.sum("of")).otherwise(F.lit(0.0))
    else:
        statistic = (F.max if alarm.statistic == "max" else F.sum)("value").cast("double")
    by_period = timed.groupBy(F.window("at", f"{alarm.seconds} seconds")).agg(statistic.alias("value"))
    period = F.call_function("div", F.unix_micros("window.start"), F.lit(alarm.seconds * 1_000_000))
    rows = by_period.select(F.lit(alarm.name).alias("name"), period.alias("period"), "value", (F.col("value") > alarm.threshold).alias("breaching"))
    return rows.groupBy("name").transformWithState(_Runs(alarm.periods), "name string, period bigint, value double, breaching boolean, alarm boolean", "append", "none")
