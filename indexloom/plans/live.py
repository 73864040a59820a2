"""Queries of the running engine: each writes the table's ticks to a log below the shared folder, runs streams over it to the end,
and returns what they published. Their SQL is that of the same figures over the whole table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import actions as acts
from ..operators import gates
from ..operators.durable import checkpoint_dir, cut
from ..sources import catalog, ticks
from ..streaming import log, messages, meters, runtime
from . import market
from .market import query

#: Offsets that a micro-batch of these queries takes, and that a segment of a partition spans; in service they are those of log. Four
#: partitions whose ticks lie four offsets apart or more give a sixteenth of ROWS for each, so half a million ticks a micro-batch.
ROWS, SEGMENT = 1 << 23, 1 << 20

#: The arrival at which a run in two rounds is split; some of the actions come before it.
ROUND = 1_500

CLOCK = 2_000_000_000_000_000_000


@dataclass
class Run:
    """A log, streams of actions and a root of published streams of one query."""

    spark: SparkSession
    folder: str

    @staticmethod
    def new(spark: SparkSession) -> Run:
        return Run(spark, f"{checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}")

    def append(self, rows: DataFrame, actions: list[tuple]) -> None:
        """Ticks to the log, and actions to their stream."""
        log.write_log(rows.select("partition", F.col("arrival").alias("offset"), codec.encode(codec.TICK).alias("value")), f"{self.folder}/ticks.raw", ticks.PARTITIONS, SEGMENT)
        catalog.local(self.spark, actions, acts.ACTION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/actions")

    def go(self, checkpoint: str = "first", snapshots: DataFrame | None = None, **more: object) -> None:
        """Runs the engine until the log ends."""
        actions = self.spark.readStream.schema(acts.ACTION_SCHEMA).parquet(f"{self.folder}/actions")
        runtime.drain(runtime.start(self.spark, self.folder, f"{self.folder}/ticks.raw", f"{self.folder}/{checkpoint}", actions, catalog.constituents(self.spark), ticks.PARTITIONS, snapshots, gates.REPORT, ROWS, SEGMENT, trigger="0 seconds", **more))


@query("live_deltas", market.ORACLES["index_value_latest"])
def live_deltas(spark, sf_dir):
    run = Run.new(spark)
    run.append(ticks.faulty_ticks(spark, sf_dir), [])
    run.go()
    return runtime.live_state(spark, run.folder)


@query("live_action_path", market.ORACLES["corporate_action_path"])
def live_action_path(spark, sf_dir):
    """In two rounds, the second of which goes on from the first one's checkpoint."""
    run = Run.new(spark)
    actions = [(o + 3, *rest) for o, *rest in market._ACTIONS]
    rows = cut(ticks.faulty_ticks(spark, sf_dir))
    run.append(rows.where(F.col("arrival") < ROUND), [a for a in actions if a[0] < ROUND])
    run.go()
    run.append(rows.where(F.col("arrival") >= ROUND), [a for a in actions if a[0] >= ROUND])
    run.go()
    state = runtime.live_state(spark, run.folder)
    divisors = messages.read_snapshots(spark, run.folder).select("index_id", "divisor")
    return state.join(divisors, "index_id").select("index_id", "sequence", "value_e8", "divisor", "level_e8", F.col("constituent_count").cast("bigint").alias("constituent_count"))


_LATEST = market.ORACLES["index_value_latest"]


@query("live_restart", f"SELECT index_id, sequence, value_e8, level_e8, timestamp_nanos, constituent_count FROM ({_LATEST})")
def live_restart(spark, sf_dir):
    """Stopped half-way, started anew from snapshots, without the first run's checkpoint, past the offsets that they name."""
    run = Run.new(spark)
    rows = cut(ticks.faulty_ticks(spark, sf_dir))
    half = (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) * 2
    run.append(rows.where(F.col("arrival") < half), [])
    run.go()
    run.append(rows.where(F.col("arrival") >= half), [])
    run.go("second", messages.read_snapshots(spark, run.folder))
    return runtime.live_state(spark, run.folder).drop("stale_constituent_count")


#: Columns of the metrics row that follow from the ticks.
_SURE = [c for c in meters.COLUMNS if c not in ("messages_per_second", "calc_duration_p99_nanos", "publication_duration_p99_nanos")]


@query(
    "live_metrics",
    f""", s AS (SELECT arrival, greatest({CLOCK} + arrival - receive_ts_nanos, 0) AS p, CASE WHEN exchange_ts_nanos > 0 THEN greatest({CLOCK} + arrival - exchange_ts_nanos, 0) END AS e,
    (SELECT count(*) FROM constituents c WHERE c.instrument_id = f.instrument_id) AS r, row_number() OVER (ORDER BY arrival DESC) AS n FROM faulty f),
c AS (SELECT count(*) AS messages_in, count(*) FILTER (WHERE result = 'applied') AS messages_out, 0::BIGINT AS dropped_messages, count(*) FILTER (WHERE result = 'stale') AS stale_ticks,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicate_events, count(*) FILTER (WHERE status = 'gap') AS sequence_gaps, count(*) FILTER (WHERE result = 'failed') AS calculation_failures FROM results),
l AS (SELECT arg_max(p, arrival)::BIGINT AS last_latency_nanos, {", ".join(f"quantile_disc(p, {q})::BIGINT AS {n}_latency_nanos" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))},
  {", ".join(f"quantile_disc(e, {q})::BIGINT AS end_to_end_{n}_nanos" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))},
  quantile_disc(r, 0.5) FILTER (WHERE n <= {meters.ROUTES})::BIGINT AS fan_out_factor_p50, quantile_disc(r, 0.99) FILTER (WHERE n <= {meters.ROUTES})::BIGINT AS fan_out_factor_p99 FROM s WHERE n <= 16384)
SELECT *, messages_in - messages_out AS ring_buffer_depth, dropped_messages + stale_ticks AS dlq_events, 0::BIGINT AS consumer_lag FROM c, l""",
    "results",
)
def live_metrics(spark, sf_dir):
    """The last metrics row, with every tick a sample and a clock that follows arrivals; without the columns that the machine's speed decides."""
    run = Run.new(spark)
    run.append(ticks.faulty_ticks(spark, sf_dir), [])
    run.go(rate=1, clock=CLOCK)
    return runtime.last_metrics(spark, run.folder).select(*_SURE)
