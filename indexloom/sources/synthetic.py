"""A synthetic exchange feed as a Python data source: ``spark.read.format("synthetic_ticks")``, also as a stream.

Draws come from a 64-bit xorshift generator in the order instrument, exchange, price, quantity. The generator is
sequential, so a reader starts from the state at its first tick; reading further batches goes on from the last one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MASK = (1 << 64) - 1
#: The state that a seed of 0 stands for.
ZERO_STATE = 0x9E3779B97F4A7C15
SCHEMA = "arrival bigint, sequence bigint, instrument_id int, exchange_id smallint, price_e8 bigint, quantity int, exchange_ts_nanos bigint, receive_ts_nanos bigint, partition int, flags tinyint"
TRADE_SYNTHETIC = 1 | 8
DEFAULTS = {"instruments": 8, "exchanges": 4, "partitions": 4, "rate": 100_000, "seed": 42, "rows": 1024, "start_nanos": 0}


def xorshift(state: int) -> int:
    state ^= state << 13 & MASK
    state ^= state >> 7
    return state ^ (state << 17 & MASK)


def route(instrument: int, partitions: int) -> int:
    if partitions <= 1:
        return 0
    h = (instrument & 0xFFFFFFFF) * 2_654_435_761 & 0xFFFFFFFF
    return h & (partitions - 1) if partitions & (partitions - 1) == 0 else h % partitions


class Feed:
    """The ticks of a seed, one after another; the clock moves on by the rate."""

    def __init__(self, options: dict[str, str] | None = None):
        given = {k.lower(): v for k, v in (options or {}).items()}
        self.o = {k: int(given.get(k, v)) for k, v in DEFAULTS.items()}
        self.state = self.o["seed"] & MASK or ZERO_STATE
        self.sequences: defaultdict[int, int] = defaultdict(int)
        self.n = 0

    def draw(self) -> int:
        self.state = xorshift(self.state)
        return self.state >> 32

    def tick(self) -> tuple:
        o = self.o
        instrument = self.draw() % o["instruments"] + 1
        exchange = self.draw() % o["exchanges"] + 1
        price = 50_000_000 + self.draw() % 20_000_000_000
        quantity = self.draw() % 5_000 + 1
        self.sequences[instrument] += 1
        now = o["start_nanos"] + self.n * 1_000_000_000 // o["rate"]
        self.n += 1
        return (self.n - 1, self.sequences[instrument], instrument, exchange, price, quantity, now - 1000, now, route(instrument, o["partitions"]), TRADE_SYNTHETIC)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed = Feed(self.options)
        for _ in range(feed.o["rows"]):
            yield feed.tick()


class _StreamReader(SimpleDataSourceStreamReader):
    """``rows`` ticks a batch; a batch that is read again is generated again from the seed."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.feed = Feed(self.options)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"n": start["n"] + self.feed.o["rows"]}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if self.feed.n > start["n"]:
            self.feed = Feed(self.options)
        while self.feed.n < start["n"]:
            self.feed.tick()
        return iter([self.feed.tick() for _ in range(end["n"] - start["n"])])


class SyntheticTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "synthetic_ticks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)
