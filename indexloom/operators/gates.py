"""Sequence gates: which ticks of an instrument count, and in which order they are applied.

Ticks arrive in the order of ``arrival``. A tick whose sequence is not above the last one is a duplicate; one that leaves
a hole is a gap, for which there are three policies. Each gate returns all its ticks with ``status`` and the order of
application (``o1``, ``o2``), which is null for ticks that are never applied.

``report`` and ``buffer_unbounded`` are windows, ``drop`` composes steps of blocks of sequences. ``gate`` takes every policy with a bounded buffer; it reads ticks
sorted by instrument and arrival and keeps the state of one instrument at a time, so no group is ever held whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .durable import cut

REPORT, BUFFER, DROP = "report", "buffer", "drop"
CAPACITY = 8

ACCEPTED, GAP, DUPLICATE, DROPPED, FULL, RECOVERED, PENDING = "accepted", "gap", "duplicate", "dropped", "full", "recovered", "pending"


def report(ticks: DataFrame) -> DataFrame:
    """Gaps are counted and applied at once. The rows keep their blocks, so that what follows shares their layout."""
    ordered = blocks.in_blocks(ticks.select("*", F.col("arrival").alias("o1"), F.lit(0).cast("bigint").alias("o2")))
    out = blocks.running(ordered, ["instrument_id"], {"__last": (blocks.MAX, F.col("sequence"))})
    last = F.greatest(F.lit(-1), F.coalesce("__last", F.lit(-1)))
    known = (F.col("sequence") > 0) & (last >= 0)
    status = F.when(known & (F.col("sequence") <= last), DUPLICATE).when(known & (F.col("sequence") > last + 1), GAP).otherwise(ACCEPTED)
    applied = F.col("status") != DUPLICATE
    return out.withColumn("status", status).select(*ticks.columns, "status", F.when(applied, F.col("o1")).alias("o1"), F.when(applied, F.col("o2")).alias("o2"), blocks.BLOCK_COLUMN)


def buffer_unbounded(ticks: DataFrame) -> DataFrame:
    """Ticks beyond a hole wait without limit until it is filled. For sequences above 0."""
    first = ticks.groupBy("instrument_id").agg(F.min_by("sequence", "arrival").alias("first"))
    copy = F.row_number().over(Window.partitionBy("instrument_id", "sequence").orderBy("arrival"))
    marked = ticks.join(first, "instrument_id").withColumn("copy", copy)
    placed = marked.withColumn("valid", (F.col("copy") == 1) & (F.col("sequence") >= F.col("first"))).withColumn("o1", F.col("sequence")).withColumn("o2", F.col("arrival"))
    valid = {"place": (blocks.SUM, F.col("valid").cast("bigint")), "filled": (blocks.MAX, F.when(F.col("valid"), F.col("arrival")))}
    placed = blocks.running(placed, ["instrument_id"], valid, before=False)
    whole = F.col("valid") & (F.col("sequence") - F.col("first") == F.col("place") - 1)
    status = F.when(~F.col("valid"), DUPLICATE).when(whole & (F.col("filled") == F.col("arrival")), ACCEPTED).when(whole, RECOVERED).otherwise(PENDING)
    out = placed.select("*", status.alias("status"), F.when(whole, F.col("filled")).alias("__o1"), F.when(whole, F.col("sequence")).alias("__o2"))
    return out.select(*ticks.columns, "status", F.col("__o1").alias("o1"), F.col("__o2").alias("o2"))


class Ruling(NamedTuple):
    """What became of a tick: its row, status and order of application."""

    row: int
    status: str
    o1: int | None
    o2: int | None


@dataclass
class Gate:
    """The state of one instrument: the last sequence, and the ticks (by sequence) that wait for a hole to fill."""

    policy: str
    capacity: int = CAPACITY
    last: int = -1
    waiting: dict[int, int] = field(default_factory=dict)

    def accept(self, row: int, sequence: int, arrival: int) -> list[Ruling]:
        """Rulings that this tick brings about, its own among them unless it has to wait."""
        beyond = sequence > 0 and self.last >= 0
        if beyond and sequence <= self.last:
            return [Ruling(row, DUPLICATE, None, None)]
        gap = beyond and sequence > self.last + 1
        if gap and self.policy == DROP:
            return [Ruling(row, DROPPED, None, None)]
        if gap and self.policy == BUFFER and self.capacity > 0:
            if sequence in self.waiting:
                return [Ruling(row, DUPLICATE, None, None)]
            if len(self.waiting) >= self.capacity:
                return [Ruling(row, FULL, None, None)]
            self.waiting[sequence] = row
            return []
        if not (gap and self.policy == BUFFER):  # without a buffer a gap is applied and leaves the last sequence as it was
            self.last = max(self.last, sequence)
        out = [Ruling(row, GAP if gap else ACCEPTED, arrival, 0)]
        while (next_row := self.waiting.pop(self.last + 1, None)) is not None:
            self.last += 1
            out.append(Ruling(next_row, RECOVERED, arrival, len(out)))
        return out

    def stuck(self) -> list[Ruling]:
        return [Ruling(row, PENDING, None, None) for row in self.waiting.values()]


def gate(ticks: DataFrame, policy: str = BUFFER, capacity: int = CAPACITY) -> DataFrame:
    """Every policy, with a buffer of ``capacity`` ticks for each instrument."""
    names = ticks.columns
    schema = T.StructType([*ticks.schema.fields, T.StructField("status", T.StringType()), T.StructField("o1", T.LongType()), T.StructField("o2", T.LongType())])
    key, order, number = names.index("instrument_id"), names.index("arrival"), names.index("sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, instrument = Gate(policy, capacity), None
        held: dict[int, pa.RecordBatch] = {}  # one row each, of the ticks that wait; at most ``capacity``
        offset = 0
        for batch in batches:
            rulings: list[Ruling] = []
            for i, (k, a, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, order, number)), strict=True)):
                if k != instrument:
                    rulings += state.stuck()
                    state, instrument = Gate(policy, capacity), k
                rulings += state.accept(offset + i, s, a)
            yield from _ruled(batch, offset, held, rulings)
            held = {r: held[r] if r < offset else batch.slice(r - offset, 1) for r in state.waiting.values()}
            offset += batch.num_rows
        if held:
            yield from _ruled(next(iter(held.values())).slice(0, 0), offset, held, state.stuck())

    def _ruled(batch: pa.RecordBatch, offset: int, held: dict[int, pa.RecordBatch], rulings: list[Ruling]) -> Iterator[pa.RecordBatch]:
        old = [r for r in rulings if r.row < offset]
        new = [r for r in rulings if r.row >= offset]
        for rows, found in ((batch.take(pa.array([r.row - offset for r in new], pa.int64())), new), *((held[r.row], [r]) for r in old)):
            columns = [*rows.columns, pa.array([r.status for r in found], pa.string()), pa.array([r.o1 for r in found], pa.int64()), pa.array([r.o2 for r in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "status", "o1", "o2"])

    return ticks.repartition("instrument_id").sortWithinPartitions("instrument_id", "arrival").mapInArrow(run, schema)


#: Sequences that a block of the drop gate spans.
SEQUENCES = 1 << 14


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of runs of rows with equal first columns."""
    key, held = None, []
    for batch in batches:
        columns = np.column_stack([np.asarray(c) for c in batch.columns[:keys]])
        edges = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1), len(columns)]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if (own := tuple(columns[a].tolist())) != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = own, []
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _next_accepted(sequences: np.ndarray, arrivals: np.ndarray) -> np.ndarray:
    """For ticks in the order of sequence and arrival: the place of the first tick of the next sequence that arrives later; -1 if there is none."""
    out = np.full(len(sequences), -1)
    edges = np.flatnonzero(np.r_[True, sequences[1:] != sequences[:-1], True])
    for a, m, z in zip(edges, edges[1:], edges[2:], strict=False):
        if sequences[m] == sequences[a] + 1:
            at = m + np.searchsorted(arrivals[m:z], arrivals[a:m], side="right")
            out[a:m] = np.where(at < z, at, -1)
    return out


def drop(ticks: DataFrame, block: int = SEQUENCES) -> DataFrame:
    """The drop policy, without going through an instrument's ticks in one task. For sequences above 0, as ``gate`` does else.

    The accepted ticks are a chain: after the first tick, always the first tick of the next sequence that arrives later than the
    one before. So a block of sequences maps the arrival of the tick that was accepted before it to that of its own last one, a
    step function with a step for each arrival of its first sequence. These are found for all blocks at once; running through
    them says where the chain enters each block; and then each block's ticks are judged. A tick before the accepted one of its
    sequence is dropped, one after it is a duplicate.
    """
    first = ticks.groupBy("instrument_id").agg(F.min_by("sequence", "arrival").alias("__first"), (F.min("arrival") - 1).alias("__start"))
    placed = ticks.join(first, "instrument_id").withColumn("__block", F.call_function("div", F.col("sequence") - F.col("__first"), F.lit(block)))
    early = ticks.join(first, "instrument_id").where(F.col("sequence") < F.col("__first")).select(*ticks.columns, F.lit(DUPLICATE).alias("status"))
    valid = placed.where(F.col("sequence") >= F.col("__first"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (instrument, number), rows in _runs(batches, 2):
            sequences, arrivals, firsts, starts = (np.asarray(rows.column(c)) for c in range(2, 6))
            following = _next_accepted(sequences, arrivals)
            # the last tick of the chain from each tick, if it reaches the block's last sequence
            ends = np.where(sequences == firsts[0] + (number + 1) * block - 1, np.arange(len(sequences)), -1)
            for i in range(len(sequences) - 1, -1, -1):
                if ends[i] < 0 and following[i] >= 0:
                    ends[i] = ends[following[i]]
            own = sequences == firsts[0] + number * block
            yield pa.RecordBatch.from_arrays([pa.array([instrument], pa.int64()), pa.array([number], pa.int64()), pa.array([int(starts[0])], pa.int64()), pa.array([arrivals[own]], pa.list_(pa.int64())), pa.array([[int(arrivals[e]) if e >= 0 else None for e in ends[own]]], pa.list_(pa.int64()))], names=["instrument_id", "block", "start", "at", "to"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instrument, expected, before = None, 0, None
        for batch in batches:
            entered = []
            for own, number, start, at, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != instrument:
                    instrument, expected, before = own, 0, start
                if number != expected:
                    before = None  # no tick has a block's sequences
                entered.append(before)
                step = bisect.bisect_right(at, before) if before is not None else len(at)
                before, expected = (to[step] if step < len(at) else None), number + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entered, pa.int64())], names=["instrument_id", "block", "enter"])

    names = [*ticks.columns, "status"]
    schema = T.StructType([*ticks.schema.fields, T.StructField("status", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, number), rows in _runs(batches, 2):
            sequences, arrivals, firsts = (np.asarray(rows.column(c)) for c in range(2, 5))
            following = _next_accepted(sequences, arrivals)
            begin, entered = firsts[0] + number * block, rows.column(5)[0].as_py()
            reached = np.full(block, np.iinfo(np.int64).max)  # by sequence: when its tick was accepted
            own = arrivals[sequences == begin]
            at = len(own) if entered is None else int(np.searchsorted(own, entered, side="right"))
            at = at if at < len(own) else -1
            while at >= 0:
                reached[sequences[at] - begin] = arrivals[at]
                at = following[at]
            when = reached[sequences - begin]
            statuses = np.where(arrivals == when, ACCEPTED, np.where(arrivals > when, DUPLICATE, DROPPED))
            for batch in rows.select(range(6, rows.num_columns)).append_column("status", pa.array(statuses.tolist(), pa.string())).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    keys = [F.col("instrument_id").cast("bigint").alias("__key"), "__block", F.col("sequence").alias("__s"), F.col("arrival").alias("__a"), "__first"]
    order = ["__key", "__block", "__s", "__a"]
    summaries = valid.select(*keys, "__start").repartition("__key", "__block").sortWithinPartitions(*order).mapInArrow(steps, "instrument_id bigint, block bigint, start bigint, at array<bigint>, to array<bigint>")
    entries = cut(summaries.repartition("instrument_id").sortWithinPartitions("instrument_id", "block").mapInArrow(enter, "instrument_id bigint, block bigint, enter bigint"))  # a row a block
    of_blocks = entries.select(F.col("instrument_id").alias("__key"), F.col("block").alias("__block"), "enter")
    judged = valid.withColumn("__key", F.col("instrument_id").cast("bigint")).join(of_blocks, ["__key", "__block"])
    ready = judged.select("__key", "__block", F.col("sequence").alias("__s"), F.col("arrival").alias("__a"), "__first", "enter", *ticks.columns).repartition("__key", "__block").sortWithinPartitions(*order)
    return ready.mapInArrow(judge, schema).unionByName(early)


def applied(gated: DataFrame) -> DataFrame:
    return gated.where("o1 IS NOT NULL")


def gate_counts(gated: DataFrame) -> DataFrame:
    """Ticks in, duplicates and gaps of each instrument; a tick that waited or was turned away by a hole is a gap."""
    count = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    return gated.groupBy("instrument_id").agg(F.count("*").alias("messages_in"), count(DUPLICATE)("duplicates"), count(GAP, DROPPED, FULL, RECOVERED, PENDING)("sequence_gaps"), count(FULL)("buffer_full"), count(ACCEPTED, GAP, RECOVERED)("applied"))
