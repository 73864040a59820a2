"""Live index values: two stateful operators in a chain, and what they start from and leave.

The first is keyed by instrument. It gates the instrument's ticks, and keeps a slot (last price, newest time, weight) for each
index that holds it; actions of those indexes reach it too, and are taken in the order of arrival with its ticks: a
change of weight acts on its own slot, all others mark where a span of the index ends. It sends on one row for each index and
span (the sum of changes), so a tick is never sent to many indexes. The second is keyed by index, folds spans and
actions into value and divisor, and sends on one row for each index that a micro-batch has touched: its value, and the
snapshot of its slots.

Both start from tables of state (``first_slots``, ``first_values``): those of constituents, or of snapshots. An action counts
at its place among the ticks of the micro-batch that brings it, and before all of them if its place has passed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import codec, fixed
from ..operators import actions as acts
from ..operators import gates, index_values
from ..operators.metrics import SAMPLES
from . import meters

SLOTS = "instrument_id int, index_id smallint, weight_e8 bigint, price_e8 bigint, newest_nanos bigint, last_sequence bigint"
VALUES = "index_id smallint, value_e8 bigint, divisor double, constituent_count bigint, sequence bigint, timestamp_nanos bigint, instrument_id int, weight_e8 bigint, price_e8 bigint, newest_nanos bigint, last_sequence bigint"

#: A row to the first operator is an action (kind 0), or ticks of one instrument (kind 1) as the bytes of a matrix of TICK.
_EVENT = ["instrument_id", "kind", "arrival", "index_id", "target", "type", "new_weight_e8", "ticks"]
TICK = ["arrival", "partition", "sequence", "price_e8", "exchange_ts_nanos", "receive_ts_nanos", "flags"]

#: Kinds of rows from the first operator to the second.
SPAN, ACTION, SLOT, METER = 0, 1, 2, 3

#: The key that what is metered goes to, beside the indexes; their ids are above 0.
ENGINE = -1
_STEP = "index_id smallint, kind int, span int, delta_e8 bigint, n bigint, stale bigint, o1 bigint, o2 bigint, receive_ts_nanos bigint, count_change int, instrument_id int, weight_e8 bigint, price_e8 bigint, newest_nanos bigint, last_sequence bigint, partition int, consumed bigint, safe bigint, meter string"

_OUT = "index_id smallint, sequence bigint, value_e8 bigint, divisor double, constituent_count bigint, stale_constituent_count bigint, timestamp_nanos bigint, instrument_ids array<int>, latest_prices_e8 array<bigint>, weights_e8 array<bigint>, last_timestamp_nanos array<bigint>, last_sequences array<bigint>, partition_offsets array<bigint>, meter string"

#: What the operators send on, as rows with names.
_STEP_ROW, _OUT_ROW = (Row(*[c.split()[0] for c in schema.split(", ")]) for schema in (_STEP, _OUT))


def first_slots(constituents: DataFrame) -> DataFrame:
    """Slots at initial prices."""
    none = F.lit(-1).cast("bigint")
    return constituents.select("instrument_id", "index_id", "weight_e8", F.col("initial_price_e8").alias("price_e8"), F.lit(0).cast("bigint").alias("newest_nanos"), none.alias("last_sequence"))


def first_values(constituents: DataFrame) -> DataFrame:
    """Base values, a row a slot."""
    base = index_values.base_values(constituents)
    zero = F.lit(0).cast("bigint")
    return first_slots(constituents).join(base, "index_id").select("index_id", F.col("base_e8").alias("value_e8"), "divisor", F.col("constituent_count").cast("bigint"), zero.alias("sequence"), zero.alias("timestamp_nanos"), "instrument_id", "weight_e8", "price_e8", "newest_nanos", "last_sequence")


def _slots_of(snapshots: DataFrame, *more: str) -> DataFrame:
    arrays = {"instrument_ids": "instrument_id", "weights_e8": "weight_e8", "latest_prices_e8": "price_e8", "last_timestamp_nanos": "newest_nanos", "last_sequences": "last_sequence"}
    return snapshots.select("index_id", *more, F.inline(F.arrays_zip(*[F.col(a).alias(n) for a, n in arrays.items()])))


def restored_slots(snapshots: DataFrame) -> DataFrame:
    return _slots_of(snapshots).select("instrument_id", "index_id", "weight_e8", "price_e8", "newest_nanos", "last_sequence")


def restored_values(snapshots: DataFrame) -> DataFrame:
    counted = snapshots.withColumn("constituent_count", F.size(F.filter("weights_e8", lambda w: w > 0)).cast("bigint"))
    slots = _slots_of(counted, "value_e8", "divisor", "constituent_count", "sequence", "timestamp_nanos")
    return slots.select("index_id", "value_e8", "divisor", "constituent_count", "sequence", "timestamp_nanos", "instrument_id", "weight_e8", "price_e8", "newest_nanos", "last_sequence")


def contribution(price_e8: int, weight_e8: int) -> int:
    """price * weight / 1e8, truncated towards zero."""
    product = price_e8 * weight_e8
    return product // fixed.SCALE if product >= 0 else -(-product // fixed.SCALE)


def _rows(rows: Iterator[Row], columns: list[str]) -> list[tuple]:
    """The rows of one key in a micro-batch, which the source bounds. Beside a key's initial state can stand a row of nulls."""
    out, take = [], None
    for r in rows:
        if take is None:  # a row looks a name up among all names
            take, sure = itemgetter(*[r.__fields__.index(c) for c in columns]), r.__fields__.index(columns[1])
        if r[sure] is not None:
            out.append(take(r))
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(instrument_id, ticks): one row for each instrument of an Arrow batch, as a stateful operator reads rows value by value."""
    for batch in batches:
        keys, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        parts = np.split(np.stack(columns, axis=1).astype("<i8")[order], starts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([p.tobytes() for p in parts[: len(found)]], pa.binary())], names=["instrument_id", "ticks"])


def _events(rows: Iterator[Row]) -> list[tuple]:
    """Actions and ticks of one instrument by arrival: (arrival, kind, the rest of either), actions first."""
    out = []
    for _, kind, arrival, *action, ticks in _rows(rows, _EVENT):
        if kind == 0:
            out.append((arrival, 0, action))
        else:
            out += [(t[0], 1, t[1:]) for t in np.frombuffer(ticks, "<i8").reshape(-1, len(TICK)).tolist()]
    return sorted(out, key=lambda e: e[:2])


class InstrumentState(StatefulProcessor):
    """Gate and slots of one instrument. Instrument 0 stands for ticks that name none: they are counted as dropped."""

    def __init__(self, policy: str, capacity: int, rate: int, clock: int | None):
        self.policy, self.capacity, self.rate, self.clock = policy, capacity, rate, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", "last bigint, consumed bigint, waiting string")
        self.slots = handle.getMapState("slots", "index_id int", "weight_e8 bigint, price_e8 bigint, newest_nanos bigint")

    def handleInitialState(self, key, initial, timerValues) -> None:
        self.slots.updateValue((initial.index_id,), (initial.weight_e8, initial.price_e8, initial.newest_nanos))
        kept = self.gate.get()  # there is a row for each slot
        self.gate.update((max(initial.last_sequence, kept[0] if kept else -1), -1, "[]"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        began = time.perf_counter_ns()
        meter = meters.Meter()
        events = _events(rows)
        if not key[0]:
            meter.dropped = sum(e[1] for e in events)
            if events:
                yield _meter_row(meter)
            return
        kept = self.gate.get() or (-1, -1, "[]")
        gate, consumed = gates.Gate(self.policy, self.capacity, kept[0]), kept[1]
        held = [tuple(t) for t in json.loads(kept[2])]
        gate.waiting = {t[1]: i for i, t in enumerate(held)}
        slots = {k[0]: list(v) for k, v in self.slots.iterator()}
        partition, before = None, {x: tuple(s) for x, s in slots.items()}
        ticks = list(held)  # (arrival, sequence, price, exchange time, receive time, flags)
        marks = dict.fromkeys(slots, 0)
        spans: dict[tuple[int, int], list] = {}
        out: list[tuple] = []
        for arrival, kind, event in events:
            if kind == 0:
                index_id, target, action, new_weight = event
                if index_id not in slots:
                    continue
                slot = slots[index_id]
                if target == key[0] and action in (acts.CHANGE, acts.ADDITION, acts.REMOVAL) and not (action == acts.ADDITION and slot[0] != 0):
                    after = 0 if action == acts.REMOVAL else new_weight or 0
                    delta = contribution(slot[1], after) - contribution(slot[1], slot[0])
                    slot[0] = after
                    out.append((index_id, ACTION, marks[index_id], delta, 1, 0, arrival, -1, None, {acts.ADDITION: 1, acts.REMOVAL: -1}.get(action, 0), *[None] * 9))
                marks[index_id] += 1
                continue
            partition, sequence, price, exchanged, received, flags = event
            consumed = max(consumed, arrival)
            ticks.append((arrival, sequence, price, exchanged, received, flags))
            if arrival % self.rate == 0:
                now = time.time_ns() if self.clock is None else self.clock + arrival
                meter.samples.append([arrival, max(now - received, 0), max(now - exchanged, 0) if exchanged > 0 else -1, len(slots)])
            rulings = gate.accept(len(ticks) - 1, sequence, arrival)
            meter.count(next((r.status for r in rulings if r.row == len(ticks) - 1), gates.PENDING))
            for ruling in rulings:
                if ruling.o1 is None:
                    continue
                _, _, price, exchanged, received, flags = ticks[ruling.row]
                taken = False
                for x, slot in slots.items():
                    if slot[0] == 0:
                        continue
                    sums = spans.setdefault((x, marks[x]), [0, 0, 0, -1, -1, None])
                    if exchanged < max(0, slot[2]):
                        sums[2] += 1
                        continue
                    sums[0] += contribution(price - slot[1], slot[0])
                    sums[1] += 1
                    sums[3:] = [ruling.o1, ruling.o2, received]
                    slot[1], slot[2] = price, exchanged
                    taken = True
                meter.result(taken, bool(flags & fixed.STALE))
        waiting = [ticks[i] for i in gate.waiting.values()]
        self.gate.update((gate.last, consumed, json.dumps(waiting)))
        out += [(x, SPAN, span, *sums[:3], sums[3], sums[4], sums[5], 0, *[None] * 9) for (x, span), sums in spans.items()]
        # a tick that waits is read again after a restart, so what was consumed ends before it
        safe = min([consumed, *(t[0] - 1 for t in waiting)])
        for x, slot in slots.items():
            if partition is not None or tuple(slot) != before[x]:
                self.slots.updateValue((x,), tuple(slot))
                out.append((x, SLOT, 0, 0, 0, 0, -1, -1, None, 0, key[0], *slot, gate.last, partition, consumed, safe, None))
        yield from (_STEP_ROW(*r) for r in out)
        if partition is not None:
            meter.samples = meter.samples[-SAMPLES:]  # they are by arrival, and no more are kept of all instruments'
            meter.calc_nanos.append(time.perf_counter_ns() - began)
            yield _meter_row(meter)

    def close(self) -> None:
        pass


def _meter_row(meter: meters.Meter) -> Row:
    return _STEP_ROW(ENGINE, METER, 0, 0, 0, 0, -1, -1, None, 0, *[None] * 8, meter.to_json())


class IndexState(StatefulProcessor):
    """Value, divisor and slots of one index; under ENGINE, counters and the last samples."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value_e8 bigint, divisor double, constituent_count bigint, sequence bigint, timestamp_nanos bigint, stale bigint")
        self.slots = handle.getMapState("slots", "instrument_id int", "weight_e8 bigint, price_e8 bigint, newest_nanos bigint, last_sequence bigint")
        self.offsets = handle.getMapState("offsets", "partition int, instrument_id int", "consumed bigint, safe bigint")
        self.metered = handle.getValueState("metered", "counters string, samples binary")

    def handleInitialState(self, key, initial, timerValues) -> None:
        self.slots.updateValue((initial.instrument_id,), (initial.weight_e8, initial.price_e8, initial.newest_nanos, initial.last_sequence))
        self.value.update((initial.value_e8, initial.divisor, initial.constituent_count, initial.sequence, initial.timestamp_nanos, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in _STEP.split(", ")]
        steps = [dict(zip(names, r, strict=True)) for r in _rows(rows, names)]
        if key[0] == ENGINE:
            metered = meters.Metered.from_state(self.metered.get())
            for s in steps:
                metered.add(meters.Meter.from_json(s["meter"]))
            self.metered.update(metered.state())
            if steps:
                yield _OUT_ROW(ENGINE, 0, 0, 0.0, 0, 0, 0, [], [], [], [], [], [], metered.row_json())
            return
        value, divisor, count, sequence, stamp, stale = self.value.get() or (0, 0.0, 0, 0, 0, 0)
        newest = (-1, -1)
        for s in sorted((s for s in steps if s["kind"] != SLOT), key=lambda s: (s["span"], s["kind"])):
            if s["kind"] == ACTION:  # at the end of its span
                after = value + s["delta_e8"]
                divisor = float(after) * divisor / float(value) if value > 0 else float(after) / fixed.BASE_LEVEL
                count += s["count_change"]
            elif s["n"] and (s["o1"], s["o2"]) > newest:
                newest, stamp = (s["o1"], s["o2"]), s["receive_ts_nanos"]
            value, sequence, stale = value + s["delta_e8"], sequence + s["n"], stale + s["stale"]
        for s in steps:
            if s["kind"] == SLOT:
                self.slots.updateValue((s["instrument_id"],), (s["weight_e8"], s["price_e8"], s["newest_nanos"], s["last_sequence"]))
                if s["partition"] is not None:
                    self.offsets.updateValue((s["partition"], s["instrument_id"]), (s["consumed"], s["safe"]))
        self.value.update((value, divisor, count, sequence, stamp, stale))
        slots = sorted((k[0], *v) for k, v in self.slots.iterator())
        held = [list(c) for c in zip(*slots, strict=True)] or [[]] * 5
        consumed: dict[int, list[tuple[int, int]]] = {}
        for (p, _), offset in self.offsets.iterator():
            consumed.setdefault(p, []).append(tuple(offset))
        offsets = [_reached(consumed.get(p, [])) for p in range(max(consumed, default=-1) + 1)]
        yield _OUT_ROW(key[0], sequence, value, divisor, count, stale, stamp, held[0], held[2], held[1], held[3], held[4], offsets, None)

    def close(self) -> None:
        pass


def _reached(offsets: list[tuple[int, int]]) -> int:
    """How far a partition is done: up to its last offset, or before the first tick that waits, if one does."""
    return min([max((c for c, _ in offsets), default=-1), *(safe for c, safe in offsets if safe < c)])


def live_values(ticks: DataFrame, actions: DataFrame, constituents: DataFrame, slots: DataFrame, values: DataFrame, policy: str = gates.BUFFER, capacity: int = gates.CAPACITY, rate: int = meters.SAMPLE_RATE, clock: int | None = None) -> DataFrame:
    """One row for each index that a micro-batch of ``ticks`` and ``actions`` (``actions.ACTION_SCHEMA``) touches, with its level.

    ``constituents`` says which instruments' operators an index's actions are sent to; ``slots`` and ``values`` are what
    the operators start from where the query has no checkpoint yet. Every ``rate``-th tick by arrival is a sample of latencies
    and routes; with a ``clock`` the time is that of a tick's arrival above it, else the machine's. One more row, of the
    index ENGINE, has in ``meter`` the engine's counters and percentiles up to the micro-batch, as JSON.
    """
    none = F.lit(None)
    numbers = ticks.select(F.coalesce("instrument_id", F.lit(0)).alias("instrument_id"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in TICK])
    packed = numbers.mapInArrow(_packed, "instrument_id int, ticks binary")
    of_ticks = packed.select("instrument_id", F.lit(1).alias("kind"), none.cast("bigint").alias("arrival"), none.cast("smallint").alias("index_id"), none.cast("int").alias("target"), none.cast("string").alias("type"), none.cast("bigint").alias("new_weight_e8"), "ticks")
    holders = constituents.select("index_id", F.col("instrument_id").alias("holder"))
    routed = actions.join(holders, "index_id")
    of_actions = routed.select(F.col("holder").alias("instrument_id"), F.lit(0).alias("kind"), F.col("o1").alias("arrival"), "index_id", F.col("instrument_id").alias("target"), "type", "new_weight_e8", none.cast("binary").alias("ticks"))
    steps = of_ticks.unionByName(of_actions).groupBy("instrument_id").transformWithState(InstrumentState(policy, capacity, rate, clock), _STEP, "append", "none", slots.groupBy("instrument_id"))
    out = steps.groupBy("index_id").transformWithState(IndexState(), _OUT, "append", "none", values.groupBy("index_id"))
    out = out.withColumns({c: F.col(c).cast("int") for c in ("constituent_count", "stale_constituent_count")})
    return out.withColumn("level_e8", fixed.level(F.col("value_e8"), F.col("divisor")))


def snapshots_of(live: DataFrame) -> DataFrame:
    """Rows of ``live_values`` as snapshots, in the columns of ``latest.snapshot``."""
    return live.where(F.col("index_id") != ENGINE).select("index_id", "sequence", "value_e8", "divisor", "instrument_ids", "latest_prices_e8", "weights_e8", "last_timestamp_nanos", "last_sequences", "timestamp_nanos", "partition_offsets")


def delta_frames(live: DataFrame) -> DataFrame:
    """(key, value): each row of ``live_values`` as a frame of 42 bytes, by index."""
    return live.where(F.col("index_id") != ENGINE).select(F.col("index_id").cast("string").alias("key"), codec.encode(codec.INDEX_VALUE).alias("value"))
