"""What the engine measures of itself: counters, latencies and routes of sampled ticks, and the row that is published."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np

from ..operators import gates
from ..operators.metrics import SAMPLES

#: A tick in so many is a sample.
SAMPLE_RATE = 128

#: Samples of routes that percentiles are taken over.
ROUTES = 4096

# Columns of the metrics row and their types, in order; the counts of the other design's garbage collector are left out.
COLUMNS = {
    "messages_in": "bigint", "messages_out": "bigint", "dropped_messages": "bigint", "stale_ticks": "bigint", "messages_per_second": "double", "last_latency_nanos": "bigint",
    "p50_latency_nanos": "bigint", "p95_latency_nanos": "bigint", "p99_latency_nanos": "bigint", "p999_latency_nanos": "bigint", "duplicate_events": "bigint", "sequence_gaps": "bigint",
    "calculation_failures": "bigint", "ring_buffer_depth": "bigint", "consumer_lag": "bigint", "end_to_end_p50_nanos": "bigint", "end_to_end_p95_nanos": "bigint", "end_to_end_p99_nanos": "bigint",
    "calc_duration_p99_nanos": "bigint", "publication_duration_p99_nanos": "bigint", "dlq_events": "bigint", "fan_out_factor_p50": "bigint", "fan_out_factor_p99": "bigint",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def percentile(values: np.ndarray, p: float) -> int:
    """The nearest-rank percentile; 0 of none."""
    if not len(values):
        return 0
    at = max(int(np.ceil(p * len(values))), 1) - 1
    return int(np.partition(values, at)[at])


@dataclass
class Meter:
    """What one instrument's ticks of a micro-batch add. A sample is arrival, latency, latency since the exchange (-1: not known), routes."""

    messages_in: int = 0
    messages_out: int = 0
    dropped: int = 0
    stale: int = 0
    duplicates: int = 0
    gaps: int = 0
    failures: int = 0
    samples: list[list[int]] = field(default_factory=list)
    calc_nanos: list[int] = field(default_factory=list)

    def count(self, status: str) -> None:
        """A tick of an instrument, by what became of it when it arrived; one that waits is pending."""
        self.messages_in += 1
        self.duplicates += status == gates.DUPLICATE
        self.gaps += status in (gates.GAP, gates.DROPPED, gates.FULL, gates.PENDING)
        self.failures += status == gates.FULL

    def result(self, taken: bool, flagged: bool) -> None:
        """An applied tick: whether an index took it, and whether the feed flagged it as stale."""
        self.messages_out += taken
        self.stale += not taken and flagged
        self.failures += not taken and not flagged

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Meter:
        return Meter(**json.loads(text))


class Metered:
    """Counters of all micro-batches so far, and the last samples."""

    def __init__(self, total: Meter, samples: np.ndarray):
        self.total, self.samples = total, samples

    @staticmethod
    def from_state(state: tuple | None) -> Metered:
        return Metered(Meter(), np.empty((0, 4), np.int64)) if state is None else Metered(Meter.from_json(state[0]), np.frombuffer(state[1], np.int64).reshape(-1, 4))

    def state(self) -> tuple[str, bytes]:
        return self.total.to_json(), self.samples.tobytes()

    def add(self, meter: Meter) -> None:
        for name in ("messages_in", "messages_out", "dropped", "stale", "duplicates", "gaps", "failures"):
            setattr(self.total, name, getattr(self.total, name) + getattr(meter, name))
        self.total.calc_nanos = (self.total.calc_nanos + meter.calc_nanos)[-SAMPLES:]
        both = np.concatenate([self.samples, np.array(meter.samples, np.int64).reshape(-1, 4)])
        self.samples = both[np.argsort(both[:, 0], kind="stable")][-SAMPLES:]

    def row_json(self) -> str:
        """The columns that follow from ticks."""
        t, latency, since = self.total, self.samples[:, 1], self.samples[:, 2]
        since, routes = since[since >= 0], self.samples[-ROUTES:, 3]
        return json.dumps({
            "messages_in": t.messages_in, "messages_out": t.messages_out, "dropped_messages": t.dropped, "stale_ticks": t.stale, "duplicate_events": t.duplicates, "sequence_gaps": t.gaps,
            "calculation_failures": t.failures, "ring_buffer_depth": t.messages_in - t.messages_out, "dlq_events": t.dropped + t.stale, "last_latency_nanos": int(latency[-1]) if len(latency) else 0,
            **{f"{n}_latency_nanos": percentile(latency, p) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))},
            **{f"end_to_end_{n}_nanos": percentile(since, p) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))},
            "fan_out_factor_p50": percentile(routes, 0.5), "fan_out_factor_p99": percentile(routes, 0.99), "calc_duration_p99_nanos": percentile(np.array(t.calc_nanos, np.int64), 0.99),
        })
