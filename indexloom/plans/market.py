"""Queries of the index engine over the table of events, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, fixed, wire
from ..operators import actions, blocks, gates, index_values, latest, metrics, refdata, sampling
from ..operators.durable import cut
from ..sources import catalog, reference, ticks
from ..streaming import messages
from ..streaming.engine import decode_frames, split_dead_letters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CONSTITUENTS = ", ".join(f"({x}::SMALLINT, {i}, {w}::BIGINT, {next(p for j, _, p in catalog.INSTRUMENTS if j == i)}::BIGINT)" for x, by in catalog.WEIGHTS.items() for i, w in by.items())

#: Common table expressions that oracles build on.
_CTES = {
    "constituents": f"constituents(index_id, instrument_id, weight_e8, initial_price_e8) AS (VALUES {_CONSTITUENTS})",
    "ticks": """ticks AS (
  SELECT event_id * 4 AS arrival, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS sequence, (user_id % 8 + 1)::INTEGER AS instrument_id,
    (CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END)::SMALLINT AS exchange_id,
    round(value::DECIMAL(28,10) * 100000000, 0)::BIGINT AS price_e8, (props->>'$.k')::INTEGER AS quantity,
    epoch_us(ts) * 1000 AS exchange_ts_nanos, epoch_us(ts) * 1000 + 1000 AS receive_ts_nanos, ((user_id % 8 + 1) & 3)::INTEGER AS partition, 1::TINYINT AS flags FROM events)""",
    "faulty": """faulty AS (
  WITH t AS (SELECT * REPLACE (exchange_ts_nanos - CASE WHEN arrival // 4 % 41 = 0 THEN 10800000000000 ELSE 0 END AS exchange_ts_nanos,
      (CASE WHEN arrival // 4 % 41 = 0 AND arrival // 4 % 2 = 0 THEN 17 ELSE 1 END)::TINYINT AS flags) FROM ticks WHERE arrival // 4 % 53 <> 0)
  SELECT * REPLACE (CASE WHEN arrival // 4 % 31 = 0 THEN arrival + 161 ELSE arrival END AS arrival) FROM t
  UNION ALL SELECT * REPLACE (arrival + 2 AS arrival) FROM t WHERE arrival // 4 % 97 = 0)""",
    "base": """base AS (
  SELECT index_id, sum(initial_price_e8::HUGEINT * weight_e8 // 100000000)::BIGINT AS base_e8, sum(initial_price_e8::HUGEINT * weight_e8 // 100000000)::BIGINT::DOUBLE / 1000.0 AS divisor,
    count(*) FILTER (WHERE weight_e8 > 0)::INTEGER AS constituent_count FROM constituents GROUP BY index_id)""",
    "reported": """reported AS (
  WITH m AS (SELECT *, greatest(-1, coalesce(max(sequence) OVER (PARTITION BY instrument_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS pm FROM faulty)
  SELECT * EXCLUDE (pm), CASE WHEN sequence > 0 AND pm >= 0 AND sequence <= pm THEN 'duplicate' WHEN sequence > 0 AND pm >= 0 AND sequence > pm + 1 THEN 'gap' ELSE 'accepted' END AS status FROM m)""",
    "routed": """routed AS (
  SELECT r.*, c.index_id, c.weight_e8, c.initial_price_e8,
    exchange_ts_nanos < greatest(0, coalesce(max(exchange_ts_nanos) OVER (PARTITION BY c.index_id, r.instrument_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stale
  FROM reported r JOIN constituents c USING (instrument_id) WHERE status <> 'duplicate' AND weight_e8 <> 0)""",
    "moved": """moved AS (
  SELECT *, (price_e8 - coalesce(lag(price_e8) OVER (PARTITION BY index_id, instrument_id ORDER BY arrival), initial_price_e8))::HUGEINT * weight_e8 // 100000000 AS delta_e8 FROM routed WHERE NOT stale)""",
    "results": """results AS (
  SELECT r.*, CASE WHEN status = 'duplicate' THEN NULL WHEN coalesce(x.taken, 0) > 0 THEN 'applied' WHEN flags & 16 <> 0 THEN 'stale' ELSE 'failed' END AS result
  FROM reported r LEFT JOIN (SELECT arrival, count(*) FILTER (WHERE NOT stale) AS taken FROM routed GROUP BY arrival) x USING (arrival))""",
    "path": """path AS (
  SELECT m.index_id, row_number() OVER w AS sequence, arrival, instrument_id, price_e8, (base_e8 + sum(delta_e8) OVER w)::BIGINT AS value_e8, receive_ts_nanos AS timestamp_nanos, divisor, constituent_count
  FROM moved m JOIN base USING (index_id) WINDOW w AS (PARTITION BY m.index_id ORDER BY arrival ROWS UNBOUNDED PRECEDING))""",
    "levels": "levels AS (SELECT *, trunc(value_e8::DOUBLE / divisor * 100000000.0)::BIGINT AS level_e8 FROM path)",
}
_ORDER = list(_CTES)


def query(name: str, oracle: str | None = None, needs: str = "", recursive: bool = False):
    """Registers a query and its oracle, with the common table expressions up to the one that it ``needs``."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ctes = [_CTES[c] for c in _ORDER[: _ORDER.index(needs) + 1]] if needs else []
            lead = "WITH RECURSIVE " if recursive else "WITH "
            ORACLES[name] = (lead + ",\n".join(ctes) + ("" if oracle.lstrip().startswith(",") else "\n") + oracle) if ctes else oracle
        return f

    return put


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.applied(gates.report(ticks.faulty_ticks(spark, sf_dir)))


@query("tick_projection", "SELECT arrival, sequence, instrument_id, exchange_id, price_e8, quantity, exchange_ts_nanos, receive_ts_nanos, partition, flags FROM ticks", "ticks")
def tick_projection(spark, sf_dir):
    return ticks.clean_ticks(spark, sf_dir)


@query("scaled_price", "SELECT event_id, round(value::DECIMAL(28,10) * 100000000, 0)::BIGINT AS price_e8, value::DECIMAL(28,8) AS price FROM events")
def scaled_price(spark, sf_dir):
    scaled = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fixed.to_scaled(F.col("value")).alias("price_e8"))
    return scaled.select("event_id", "price_e8", fixed.from_scaled(F.col("price_e8")).alias("price"))


@query(
    "partition_route",
    "SELECT id, " + ", ".join(f"({f'h & {n - 1}' if n & (n - 1) == 0 else f'h % {n}'})::INTEGER AS p{n}" for n in (2, 3, 4, 5, 6, 8, 32)) + " FROM (SELECT DISTINCT user_id AS id, ((user_id & 4294967295) * 2654435761) & 4294967295 AS h FROM events)",
)
def partition_route(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    return ids.select("id", *[fixed.route(F.col("id"), n).alias(f"p{n}") for n in (2, 3, 4, 5, 6, 8, 32)])


@query(
    "index_base",
    """WITH f AS (SELECT l_suppkey, l_partkey, min((l_orderkey, l_linenumber)) AS p FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey + 1 AS index_id, (p[1] % 1000 + 1) * 1000000 AS price, count(*) OVER w AS n, p = min(p) OVER w AS first FROM f WINDOW w AS (PARTITION BY l_suppkey)),
w AS (SELECT *, 100000000 // n + CASE WHEN first THEN 100000000 % n ELSE 0 END AS weight FROM c)
SELECT index_id, sum(price::HUGEINT * weight // 100000000)::BIGINT AS base_e8, sum(price::HUGEINT * weight // 100000000)::BIGINT::DOUBLE / 1000.0 AS divisor, count(*) FILTER (WHERE weight > 0)::INTEGER AS constituent_count FROM w GROUP BY index_id""",
)
def index_base(spark, sf_dir):
    """Indexes of suppliers over the parts of their line items."""
    return index_values.base_values(reference.constituents(spark, sf_dir, faulty=False))


@query(
    "index_value_latest",
    """SELECT b.index_id, coalesce(m.n, 0)::BIGINT AS sequence, (base_e8 + coalesce(m.d, 0))::BIGINT AS value_e8, trunc((base_e8 + coalesce(m.d, 0))::BIGINT::DOUBLE / divisor * 100000000.0)::BIGINT AS level_e8,
  coalesce(m.t, 0)::BIGINT AS timestamp_nanos, constituent_count, coalesce(s.n, 0)::INTEGER AS stale_constituent_count
FROM base b LEFT JOIN (SELECT index_id, count(*) AS n, sum(delta_e8) AS d, arg_max(receive_ts_nanos, arrival) AS t FROM moved GROUP BY index_id) m USING (index_id)
LEFT JOIN (SELECT index_id, count(*) FILTER (WHERE stale) AS n FROM routed GROUP BY index_id) s USING (index_id)""",
    "moved",
)
def index_value_latest(spark, sf_dir):
    return index_values.latest_values(_applied(spark, sf_dir), catalog.constituents(spark))


@query("index_value_path", "SELECT index_id, sequence, arrival, instrument_id, price_e8, value_e8, level_e8, timestamp_nanos, constituent_count FROM levels", "levels")
def index_value_path(spark, sf_dir):
    return index_values.value_path(_applied(spark, sf_dir), catalog.constituents(spark)).drop("o1", "o2")


@query(
    "index_value_prevalidated",
    """, d AS (SELECT r.arrival, c.index_id, (price_e8 - coalesce(lag(price_e8) OVER (PARTITION BY c.index_id, r.instrument_id ORDER BY arrival), initial_price_e8))::HUGEINT * weight_e8 // 100000000 AS delta
  FROM reported r JOIN constituents c USING (instrument_id) WHERE status <> 'duplicate')
SELECT b.index_id, (base_e8 + sum(delta))::BIGINT AS value_e8, count(*) AS sequence FROM d JOIN base b USING (index_id) GROUP BY b.index_id, base_e8""",
    "reported",
)
def index_value_prevalidated(spark, sf_dir):
    return index_values.latest_values(_applied(spark, sf_dir), catalog.constituents(spark), prevalidated=True).select("index_id", "value_e8", "sequence")


@query(
    "index_recomputed",
    """, l AS (SELECT instrument_id, arg_max(price_e8, arrival) AS p FROM reported WHERE status <> 'duplicate' GROUP BY instrument_id)
SELECT index_id, sum(coalesce(p, initial_price_e8)::HUGEINT * weight_e8 // 100000000)::BIGINT AS value_e8 FROM constituents LEFT JOIN l USING (instrument_id) GROUP BY index_id""",
    "reported",
)
def index_recomputed(spark, sf_dir):
    return index_values.recomputed_values(_applied(spark, sf_dir), catalog.constituents(spark))


@query("seq_report_status", "SELECT arrival, instrument_id, sequence, status FROM reported", "reported")
def seq_report_status(spark, sf_dir):
    return gates.report(ticks.faulty_ticks(spark, sf_dir)).select("arrival", "instrument_id", "sequence", "status")


@query(
    "seq_buffer_status",
    """, f AS (SELECT *, first_value(sequence) OVER (PARTITION BY instrument_id ORDER BY arrival) AS fs, row_number() OVER (PARTITION BY instrument_id, sequence ORDER BY arrival) AS cp FROM faulty),
v AS (SELECT *, row_number() OVER w AS place, max(arrival) OVER w AS filled FROM f WHERE cp = 1 AND sequence >= fs WINDOW w AS (PARTITION BY instrument_id ORDER BY sequence ROWS UNBOUNDED PRECEDING))
SELECT arrival, instrument_id, sequence, CASE WHEN sequence - fs <> place - 1 THEN 'pending' WHEN filled = arrival THEN 'accepted' ELSE 'recovered' END AS status,
  CASE WHEN sequence - fs = place - 1 THEN filled ELSE -1 END AS o1 FROM v
UNION ALL SELECT arrival, instrument_id, sequence, 'duplicate', -1 FROM f WHERE NOT (cp = 1 AND sequence >= fs)""",
    "faulty",
)
def seq_buffer_status(spark, sf_dir):
    return gates.buffer_unbounded(ticks.faulty_ticks(spark, sf_dir)).select("arrival", "instrument_id", "sequence", "status", F.coalesce("o1", F.lit(-1)).alias("o1"))


@query(
    "seq_bounded_status",
    """, o AS (SELECT arrival, instrument_id, sequence, row_number() OVER (PARTITION BY instrument_id ORDER BY arrival) AS i FROM faulty),
s AS (SELECT instrument_id, 0::BIGINT AS i, 0::BIGINT AS arrival, 0::BIGINT AS sequence, '' AS status, -1::BIGINT AS low, 0::BIGINT AS freed, -1::BIGINT AS last, []::BIGINT[] AS waiting FROM (SELECT DISTINCT instrument_id FROM o)
  UNION ALL
  SELECT instrument_id, i, arrival, sequence, status, low, freed, low + freed,
    CASE status WHEN 'waits' THEN list_append(waiting, sequence) ELSE list_filter(waiting, lambda x: x > low + freed) END
  FROM (SELECT *, CASE WHEN status = 'accepted' THEN len(list_filter(generate_series(1, 8), lambda k: len(list_filter(waiting, lambda x: x > low AND x <= low + k)) = k)) ELSE 0 END AS freed
    FROM (SELECT *, CASE WHEN status = 'accepted' THEN greatest(last, sequence) ELSE last END AS low
      FROM (SELECT o.*, s.last, s.waiting, CASE WHEN last >= 0 AND o.sequence > 0 AND o.sequence <= last THEN 'duplicate' WHEN NOT (last >= 0 AND o.sequence > 0 AND o.sequence > last + 1) THEN 'accepted'
          WHEN list_contains(waiting, o.sequence) THEN 'duplicate' WHEN len(waiting) >= 8 THEN 'full' ELSE 'waits' END AS status FROM s JOIN o ON o.instrument_id = s.instrument_id AND o.i = s.i + 1))))
SELECT t.arrival, t.instrument_id, t.sequence, CASE WHEN t.status = 'waits' THEN CASE WHEN f.i IS NULL THEN 'pending' ELSE 'recovered' END ELSE t.status END AS status,
  CASE t.status WHEN 'accepted' THEN t.arrival WHEN 'waits' THEN f.arrival END AS o1, CASE t.status WHEN 'accepted' THEN 0 WHEN 'waits' THEN t.sequence - f.low END AS o2
FROM s t LEFT JOIN s f ON t.status = 'waits' AND f.instrument_id = t.instrument_id AND f.i > t.i AND f.freed > 0 AND t.sequence > f.low AND t.sequence <= f.low + f.freed WHERE t.i > 0""",
    "faulty",
    recursive=True,
)
def seq_bounded_status(spark, sf_dir):
    return gates.gate(ticks.faulty_ticks(spark, sf_dir), gates.BUFFER).select("arrival", "instrument_id", "sequence", "status", "o1", "o2")


@query(
    "seq_drop_status",
    """, o AS (SELECT arrival, instrument_id, sequence, row_number() OVER (PARTITION BY instrument_id ORDER BY arrival) AS i FROM faulty),
w AS (SELECT arrival, instrument_id, sequence, i, 'accepted' AS status, sequence AS last FROM o WHERE i = 1
  UNION ALL SELECT o.arrival, o.instrument_id, o.sequence, o.i, CASE WHEN o.sequence <= w.last THEN 'duplicate' WHEN o.sequence > w.last + 1 THEN 'dropped' ELSE 'accepted' END,
    CASE WHEN o.sequence = w.last + 1 THEN o.sequence ELSE w.last END FROM w JOIN o ON o.instrument_id = w.instrument_id AND o.i = w.i + 1)
SELECT arrival, instrument_id, sequence, status FROM w""",
    "faulty",
    recursive=True,
)
def seq_drop_status(spark, sf_dir):
    return gates.drop(ticks.faulty_ticks(spark, sf_dir)).select("arrival", "instrument_id", "sequence", "status")


@query(
    "gate_counts",
    "SELECT instrument_id, count(*) AS messages_in, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'gap') AS sequence_gaps, 0::BIGINT AS buffer_full, count(*) FILTER (WHERE status <> 'duplicate') AS applied FROM reported GROUP BY instrument_id",
    "reported",
)
def gate_counts(spark, sf_dir):
    return gates.gate_counts(gates.report(ticks.faulty_ticks(spark, sf_dir)))


@query("stale_status", "SELECT index_id, arrival, stale FROM routed", "routed")
def stale_status(spark, sf_dir):
    return index_values.fan_out(index_values.stale_gate(_applied(spark, sf_dir)), catalog.constituents(spark)).select("index_id", "arrival", "stale")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_values.tick_status(gates.report(ticks.faulty_ticks(spark, sf_dir)), catalog.constituents(spark))


@query("reject_class", "SELECT status, result, count(*) AS n FROM results GROUP BY status, result", "results")
def reject_class(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("status", "result").agg(F.count("*").alias("n"))


@query(
    "counters",
    """, c AS (SELECT count(*) AS messages_in, count(*) FILTER (WHERE result = 'applied') AS messages_out, 0::BIGINT AS dropped, count(*) FILTER (WHERE result = 'stale') AS stale,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'gap') AS sequence_gaps, count(*) FILTER (WHERE result = 'failed') AS calculation_failures FROM results)
SELECT *, dropped + stale AS dead_letters, messages_in - messages_out AS unresolved FROM c""",
    "results",
)
def counters(spark, sf_dir):
    return metrics.counters(_results(spark, sf_dir))


_MANY = "many(index_id, instrument_id) AS (SELECT (i // 8 + 1000)::SMALLINT, ((i // 8 * 4 + i % 8) % 256 + 1)::INTEGER FROM range(512) t(i)),\n wide AS (SELECT arrival, (arrival // 4 % 300 + 1)::INTEGER AS instrument_id FROM ticks)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.raw_ticks(spark, sf_dir).select("arrival", ((F.col("arrival") / 4).cast("bigint") % 300 + 1).cast("int").alias("instrument_id"))


@query("fanout_factor", f", {_MANY}\nSELECT arrival, instrument_id, count(m.index_id) AS routes FROM wide LEFT JOIN many m USING (instrument_id) GROUP BY arrival, instrument_id", "ticks")
def fanout_factor(spark, sf_dir):
    return index_values.fan_out_factor(_wide(spark, sf_dir), catalog.many_constituents(spark))


@query(
    "fanout_percentiles",
    f", {_MANY}, r AS (SELECT arrival, count(m.index_id) AS v FROM wide LEFT JOIN many m USING (instrument_id) GROUP BY arrival), l AS (SELECT v FROM r ORDER BY arrival DESC LIMIT 4096)\nSELECT count(*) AS samples, quantile_disc(v, 0.5)::BIGINT AS p50, quantile_disc(v, 0.99)::BIGINT AS p99 FROM l",
    "ticks",
)
def fanout_percentiles(spark, sf_dir):
    return metrics.percentiles(index_values.fan_out_factor(_wide(spark, sf_dir), catalog.many_constituents(spark)), F.col("routes"), F.col("arrival"), samples=4096, wanted={"p50": 0.5, "p99": 0.99})


@query(
    "latency_percentiles",
    """, l AS (SELECT exchange_id, greatest(0, (price_e8 % 5000000) - quantity) AS v, row_number() OVER (PARTITION BY exchange_id ORDER BY arrival DESC) AS n FROM ticks)
SELECT exchange_id, count(*) AS samples, quantile_disc(v, 0.5)::BIGINT AS p50, quantile_disc(v, 0.95)::BIGINT AS p95, quantile_disc(v, 0.99)::BIGINT AS p99, quantile_disc(v, 0.999)::BIGINT AS p999 FROM l WHERE n <= 16384 GROUP BY exchange_id""",
    "ticks",
)
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(ticks.raw_ticks(spark, sf_dir), F.col("price_e8") % 5_000_000 - F.col("quantity"), F.col("arrival"), by=["exchange_id"])


@query("throughput", "SELECT count(*) AS messages, (max(receive_ts_nanos) - min(receive_ts_nanos))::DOUBLE / 1e9 AS seconds, count(*) / ((max(receive_ts_nanos) - min(receive_ts_nanos))::DOUBLE / 1e9) AS per_second FROM ticks", "ticks")
def throughput(spark, sf_dir):
    return metrics.throughput(ticks.raw_ticks(spark, sf_dir))


@query("delta_every_n", "SELECT (arrival // 4096) AS bucket, index_id, max(sequence) AS sequence, arg_max(value_e8, sequence) AS value_e8, arg_max(level_e8, sequence) AS level_e8, arg_max(timestamp_nanos, sequence) AS timestamp_nanos FROM levels GROUP BY ALL", "levels")
def delta_every_n(spark, sf_dir):
    return latest.every_n(index_values.value_path(_applied(spark, sf_dir), catalog.constituents(spark)), 4096)


def _shuffled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = index_values.value_path(_applied(spark, sf_dir), catalog.constituents(spark))
    return path.select("index_id", "sequence", "value_e8", "level_e8", (F.col("arrival") + F.when(F.col("sequence") % 7 == 0, 100_000_000).otherwise(0)).alias("arrival"))


@query(
    "latest_upsert",
    """, v AS (SELECT *, arrival + CASE WHEN sequence % 7 = 0 THEN 100000000 ELSE 0 END AS a FROM levels),
stored AS (SELECT index_id, max(sequence) AS s FROM v WHERE sequence % 1000 < 500 GROUP BY index_id),
news AS (SELECT index_id, arg_max(sequence, a) AS s FROM v WHERE sequence % 1000 >= 500 GROUP BY index_id),
won AS (SELECT index_id, coalesce(greatest(stored.s, news.s), stored.s, news.s) AS sequence FROM stored FULL JOIN news USING (index_id))
SELECT index_id, sequence, value_e8, level_e8 FROM won JOIN levels USING (index_id, sequence)""",
    "levels",
)
def latest_upsert(spark, sf_dir):
    """A table that has seen every other 500 values is flushed with the rest, whose last arrival is not their highest sequence."""
    values = _shuffled_values(spark, sf_dir)
    first = F.col("sequence") % 1000 < 500
    row = F.struct("sequence", "value_e8", "level_e8", "arrival")
    both = cut(values.groupBy("index_id").agg(F.max_by(row, F.when(first, F.col("sequence"))).alias("stored"), F.max_by(row, F.when(~first, F.col("arrival"))).alias("news")))  # a row an index
    stored = both.where("stored IS NOT NULL").select("index_id", "stored.*").drop("arrival")
    return latest.upsert(stored, both.where("news IS NOT NULL").select("index_id", "news.*"))


@query(
    "live_state",
    ", v AS (SELECT *, arrival + CASE WHEN sequence % 7 = 0 THEN 100000000 ELSE 0 END AS a FROM levels) SELECT index_id, max(a) AS arrival, arg_max(sequence, a) AS sequence, arg_max(value_e8, a) AS value_e8, arg_max(level_e8, a) AS level_e8 FROM v GROUP BY index_id",
    "levels",
)
def live_state(spark, sf_dir):
    return latest.latest_by_arrival(_shuffled_values(spark, sf_dir))


@query(
    "snapshot_slots",
    """, s AS (SELECT index_id, instrument_id, arg_max(price_e8, arrival) AS p, max(exchange_ts_nanos) AS t FROM moved GROUP BY ALL),
l AS (SELECT instrument_id, max(sequence) AS last FROM reported WHERE status <> 'duplicate' GROUP BY instrument_id)
SELECT index_id, instrument_id, coalesce(p, initial_price_e8)::BIGINT AS latest_price_e8, weight_e8, coalesce(t, 0)::BIGINT AS last_timestamp_nanos, coalesce(last, -1)::BIGINT AS last_sequence
FROM constituents LEFT JOIN s USING (index_id, instrument_id) LEFT JOIN l USING (instrument_id)""",
    "moved",
)
def snapshot_slots(spark, sf_dir):
    snap = latest.snapshot(gates.report(ticks.faulty_ticks(spark, sf_dir)), catalog.constituents(spark))
    return snap.select("index_id", F.inline(F.arrays_zip(F.col("instrument_ids").alias("instrument_id"), F.col("latest_prices_e8").alias("latest_price_e8"), "weights_e8", F.col("last_timestamp_nanos").alias("last_timestamp_nanos"), F.col("last_sequences").alias("last_sequence")))).withColumnRenamed("weights_e8", "weight_e8")


@query(
    "restore_replay",
    """, m AS (SELECT t.*, c.index_id, c.weight_e8, (price_e8 - coalesce(lag(price_e8) OVER (PARTITION BY c.index_id, t.instrument_id ORDER BY arrival), initial_price_e8))::HUGEINT * weight_e8 // 100000000 AS d FROM ticks t JOIN constituents c USING (instrument_id))
SELECT b.index_id, count(*) AS sequence, (base_e8 + sum(d))::BIGINT AS value_e8, trunc((base_e8 + sum(d))::BIGINT::DOUBLE / divisor * 100000000.0)::BIGINT AS level_e8 FROM m JOIN base b USING (index_id) GROUP BY b.index_id, base_e8, divisor""",
    "base",
)
def restore_replay(spark, sf_dir):
    all_ticks = index_values.in_order(ticks.clean_ticks(spark, sf_dir)).withColumn("status", F.lit(gates.ACCEPTED))
    before = F.col("arrival") < 2_000 * 4  # one arrival, so that the snapshot is a prefix at every size
    snap = latest.snapshot(all_ticks.where(before), catalog.constituents(spark))
    return latest.restored_values(snap, all_ticks.where(~before))


_ACTIONS = [(600, 100, 1, "ConstituentRemoval", 0), (800, 101, 2, "WeightChange", 20_000_000), (1_001, 100, 1, "ConstituentAddition", 18_000_000), (1_203, 102, 7, "ConstituentRemoval", 0), (1_405, 100, 3, "ConstituentAddition", 5), (1_607, 101, 9, "WeightChange", 7), (1_809, 102, 7, "ConstituentAddition", 30_000_000), (2_011, 102, 8, "Split", 3)]


_WEIGHTS = """acts(o1, index_id, instrument_id, type, new_weight_e8) AS (VALUES {rows}),
known AS (SELECT a.*, c.weight_e8, row_number() OVER (PARTITION BY index_id, instrument_id ORDER BY o1) AS n FROM acts a JOIN constituents c USING (index_id, instrument_id) WHERE type IN ('WeightChange', 'ConstituentAddition', 'ConstituentRemoval')),
folded AS (SELECT DISTINCT index_id, instrument_id, 0::BIGINT AS n, 0::BIGINT AS o1, '' AS type, weight_e8 AS w_before, weight_e8 AS w_after, false AS done FROM known
  UNION ALL SELECT k.index_id, k.instrument_id, k.n, k.o1, k.type, f.w_after, CASE WHEN k.type = 'ConstituentRemoval' THEN 0 WHEN k.type = 'ConstituentAddition' AND f.w_after <> 0 THEN f.w_after ELSE k.new_weight_e8 END,
    NOT (k.type = 'ConstituentAddition' AND f.w_after <> 0) FROM folded f JOIN known k ON k.index_id = f.index_id AND k.instrument_id = f.instrument_id AND k.n = f.n + 1),
history AS (SELECT index_id, instrument_id, o1, type, w_before, w_after FROM folded WHERE done)""".format(rows=", ".join(f"({o + 3}::BIGINT, {x}::SMALLINT, {i}, '{t}', {w}::BIGINT)" for o, x, i, t, w in _ACTIONS))


@query(
    "corporate_action_path",
    f""", {_WEIGHTS},
weighed AS (SELECT t.arrival AS o1, t.instrument_id, t.price_e8, t.exchange_ts_nanos AS ts, c.index_id, c.initial_price_e8, coalesce(h.w_after, c.weight_e8) AS w
  FROM (SELECT r.*, c.index_id FROM reported r JOIN constituents c USING (instrument_id) WHERE status <> 'duplicate') t JOIN constituents c ON c.index_id = t.index_id AND c.instrument_id = t.instrument_id
  ASOF LEFT JOIN history h ON h.index_id = t.index_id AND h.instrument_id = t.instrument_id AND t.arrival >= h.o1),
aged AS (SELECT *, ts < greatest(0, coalesce(max(ts) OVER (PARTITION BY index_id, instrument_id ORDER BY o1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stale FROM weighed WHERE w <> 0),
fresh AS (SELECT *, (price_e8 - coalesce(lag(price_e8) OVER (PARTITION BY index_id, instrument_id ORDER BY o1), initial_price_e8))::HUGEINT * w // 100000000 AS delta FROM aged WHERE NOT stale),
acted AS (SELECT h.*, coalesce(f.price_e8, c.initial_price_e8) AS p FROM history h JOIN constituents c ON c.index_id = h.index_id AND c.instrument_id = h.instrument_id
  ASOF LEFT JOIN fresh f ON f.index_id = h.index_id AND f.instrument_id = h.instrument_id AND h.o1 > f.o1),
steps AS (SELECT index_id, o1, 0 AS o2, delta, NULL::VARCHAR AS type FROM fresh
  UNION ALL SELECT index_id, o1, -1, p::HUGEINT * w_after // 100000000 - p::HUGEINT * w_before // 100000000, type FROM acted),
sums AS (SELECT s.*, (base_e8 + sum(delta) OVER (PARTITION BY s.index_id ORDER BY o1, o2 ROWS UNBOUNDED PRECEDING))::BIGINT AS v FROM steps s JOIN base USING (index_id)),
events_of AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY o1) AS n FROM sums WHERE type IS NOT NULL),
divisors AS (SELECT index_id, 0::BIGINT AS n, divisor AS d FROM base
  UNION ALL SELECT e.index_id, e.n, CASE WHEN e.v - e.delta > 0 THEN e.v::DOUBLE * d / (e.v - e.delta)::DOUBLE ELSE e.v::DOUBLE / 1000.0 END FROM divisors x JOIN events_of e ON e.index_id = x.index_id AND e.n = x.n + 1),
totals AS (SELECT index_id, count(*) AS n, sum(delta) AS delta, coalesce(sum(CASE type WHEN 'ConstituentAddition' THEN 1 WHEN 'ConstituentRemoval' THEN -1 ELSE 0 END), 0) AS change FROM steps GROUP BY index_id)
SELECT b.index_id, coalesce(t.n, 0)::BIGINT AS sequence, (base_e8 + coalesce(delta, 0))::BIGINT AS value_e8, d.d AS divisor, trunc((base_e8 + coalesce(delta, 0))::BIGINT::DOUBLE / d.d * 100000000.0)::BIGINT AS level_e8,
  (constituent_count + coalesce(change, 0))::BIGINT AS constituent_count
FROM base b LEFT JOIN totals t USING (index_id) JOIN (SELECT index_id, arg_max(d, n) AS d FROM divisors GROUP BY index_id) d USING (index_id)""",
    "reported",
    recursive=True,
)
def corporate_action_path(spark, sf_dir):
    rows = catalog.local(spark, [(o + 3, *rest) for o, *rest in _ACTIONS], actions.ACTION_SCHEMA)
    return actions.values_after_actions(_applied(spark, sf_dir), catalog.constituents(spark), rows)


_TYPES = {"click": "WeightChange", "error": "ConstituentRemoval", "purchase": "ConstituentAddition", "signup": "ConstituentAddition"}


@query(
    "corporate_action_weights",
    f""", acts AS (SELECT event_id * 4 + 3 AS o1, (100 + event_id % 4)::SMALLINT AS index_id, (user_id % 8 + 1)::INTEGER AS instrument_id, CASE event_type {" ".join(f"WHEN '{e}' THEN '{t}'" for e, t in _TYPES.items())} ELSE 'Split' END AS type,
    CASE WHEN (props->>'$.k')::BIGINT % 5 = 0 THEN 0 ELSE (props->>'$.k')::BIGINT * 1000000 END AS new_weight_e8 FROM events WHERE event_id % 7 = 0),
known AS (SELECT a.*, c.weight_e8, row_number() OVER (PARTITION BY index_id, instrument_id ORDER BY o1) AS n FROM acts a JOIN constituents c USING (index_id, instrument_id) WHERE type <> 'Split'),
folded AS (SELECT DISTINCT index_id, instrument_id, 0::BIGINT AS n, 0::BIGINT AS o1, '' AS type, weight_e8 AS w_before, weight_e8 AS w_after, false AS done FROM known
  UNION ALL SELECT k.index_id, k.instrument_id, k.n, k.o1, k.type, f.w_after, CASE WHEN k.type = 'ConstituentRemoval' THEN 0 WHEN k.type = 'ConstituentAddition' AND f.w_after <> 0 THEN f.w_after ELSE k.new_weight_e8 END,
    NOT (k.type = 'ConstituentAddition' AND f.w_after <> 0) FROM folded f JOIN known k ON k.index_id = f.index_id AND k.instrument_id = f.instrument_id AND k.n = f.n + 1)
SELECT index_id, instrument_id, o1, type, w_before::BIGINT AS w_before, w_after::BIGINT AS w_after FROM folded WHERE done""",
    "constituents",
    recursive=True,
)
def corporate_action_weights(spark, sf_dir):
    """Every seventh event is an action on a constituent of the catalog; some name no index of it, or are of no known type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 7 = 0")
    kind = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in _TYPES.items()], F.lit("Split"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.select((F.col("event_id") * 4 + 3).alias("o1"), (F.col("event_id") % 4 + 100).cast("smallint").alias("index_id"), (F.col("user_id") % 8 + 1).cast("int").alias("instrument_id"), kind.alias("type"), F.when(k % 5 == 0, 0).otherwise(k * 1_000_000).cast("bigint").alias("new_weight_e8"))
    return actions.weight_history(rows, catalog.constituents(spark))


@query("replay_offsets", "SELECT p::INTEGER AS partition, coalesce(min(o) FILTER (WHERE o >= 0) + 1, 0)::BIGINT AS start_offset FROM (SELECT partition AS p, CASE WHEN partition = 3 THEN -1 ELSE max(arrival) - instrument_id END AS o FROM ticks GROUP BY partition, instrument_id) GROUP BY p", "ticks")
def replay_offsets(spark, sf_dir):
    offset = F.when(F.col("partition") == 3, -1).otherwise(F.max("arrival") - F.col("instrument_id"))
    by = ticks.raw_ticks(spark, sf_dir).groupBy("partition", "instrument_id").agg(offset.alias("offset"))
    # instruments come two to a partition; the n-th of each makes the n-th snapshot
    nth = by.withColumn("snapshot", F.floor((F.col("instrument_id") - 1) / 4))
    arrays = nth.groupBy("snapshot").agg(F.transform(F.array_sort(F.collect_list(F.struct("partition", "offset"))), lambda x: x["offset"]).alias("partition_offsets"))
    return latest.replay_offsets(arrays)


@query("consumer_lag", "SELECT event_id AS id, coalesce(CASE WHEN (props->>'$.k')::BIGINT >= 50 THEN (props->>'$.k')::BIGINT END, 0) + 3 AS consumer_lag FROM events")
def consumer_lag(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    document = F.format_string('{"topics":{"ticks.raw":{"partitions":{"0":{"consumer_lag":%d},"1":{"consumer_lag":3},"-1":{"consumer_lag":99},"2":{"consumer_lag":-1}}}}}', F.when(k >= 50, k).otherwise(0))
    return latest.consumer_lag(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), document.alias("json")), "ticks.raw")


@query(
    "refdata_errors",
    f"""WITH {reference.FAULTY_SQL}, valid AS (SELECT * FROM inst WHERE instrument_id > 0),
of_index AS (SELECT con.*, code, idx.currency AS index_currency, methodology FROM con JOIN idx USING (index_id)),
facts AS (SELECT instrument_id, arg_max(currency, symbol) AS currency, bool_or(is_active) AS is_active FROM valid GROUP BY instrument_id),
known AS (SELECT *, 'Index ''' || code || ''' constituent ' || instrument_id || ' ' AS item FROM of_index JOIN facts USING (instrument_id)),
top AS (SELECT (SELECT count(*) FROM inst) AS n, greatest((SELECT max(instrument_id) FROM inst), (SELECT max(instrument_id) FROM con)) AS top)
SELECT rule, entity, message FROM (
  SELECT 'V1' AS rule, 'snapshot' AS entity, 'Reference data version must be positive.' AS message UNION ALL SELECT 'V2', 'snapshot', 'Reference data must contain at least one instrument.' UNION ALL SELECT 'V3', 'snapshot', 'Reference data must contain at least one index.'
  UNION ALL SELECT 'V4', 'snapshot', 'Instrument ids must be normalized to dense internal ids for array indexing; count=' || n || ', maxId=' || top || '.' FROM top WHERE top > 4 * n
  UNION ALL SELECT 'V5', symbol, 'Instrument ''' || symbol || ''' has non-positive instrument id ' || instrument_id || '.' FROM inst WHERE instrument_id <= 0
  UNION ALL SELECT 'V6', instrument_id::VARCHAR, 'Duplicate instrument id ' || instrument_id || '.' FROM valid GROUP BY instrument_id HAVING count(*) > 1
  UNION ALL SELECT 'V7', instrument_id::VARCHAR, 'Instrument id ' || instrument_id || ' is missing symbol.' FROM valid WHERE trim(symbol) = ''
  UNION ALL SELECT 'V8', upper(symbol), 'Duplicate instrument symbol ''' || upper(symbol) || '''.' FROM valid WHERE trim(symbol) <> '' GROUP BY upper(symbol) HAVING count(*) > 1
  UNION ALL SELECT 'V9', symbol, 'Instrument ''' || symbol || ''' is missing currency.' FROM valid WHERE trim(currency) = ''
  UNION ALL SELECT 'V10', code, 'Index ''' || code || ''' has non-positive index id ' || index_id || '.' FROM idx WHERE index_id <= 0
  UNION ALL SELECT 'V11', index_id::VARCHAR, 'Duplicate index id ' || index_id || '.' FROM idx WHERE index_id > 0 GROUP BY index_id HAVING count(*) > 1
  UNION ALL SELECT 'V12', index_id::VARCHAR, 'Index id ' || index_id || ' is missing code.' FROM idx WHERE trim(code) = ''
  UNION ALL SELECT 'V13', upper(code), 'Duplicate index code ''' || upper(code) || '''.' FROM idx WHERE trim(code) <> '' GROUP BY upper(code) HAVING count(*) > 1
  UNION ALL SELECT 'V14', code, 'Index ''' || code || ''' is missing currency.' FROM idx WHERE trim(currency) = ''
  UNION ALL SELECT 'V15', code, 'Index ''' || code || ''' version ' || version || ' does not match snapshot version 1.' FROM idx WHERE version > 0 AND version <> 1
  UNION ALL SELECT 'V16', code, 'Index ''' || code || ''' effective timestamp does not match snapshot timestamp.' FROM idx WHERE effective_from_nanos > 0 AND effective_from_nanos <> 1
  UNION ALL SELECT 'V17', code, 'Index ''' || code || ''' must contain at least one constituent.' FROM idx WHERE index_id NOT IN (SELECT index_id FROM con)
  UNION ALL SELECT 'V18', code, 'Index ''' || code || ''' references unknown instrument id ' || instrument_id || '.' FROM of_index WHERE instrument_id NOT IN (SELECT instrument_id FROM valid)
  UNION ALL SELECT 'V19', code, 'Index ''' || code || ''' has duplicate constituent instrument id ' || instrument_id || '.' FROM known GROUP BY index_id, code, instrument_id HAVING count(*) > 1
  UNION ALL SELECT 'V20', code, 'Index ''' || code || ''' references inactive instrument id ' || instrument_id || '.' FROM known WHERE NOT is_active AND NOT placeholder
  UNION ALL SELECT 'V21', code, item || 'has non-positive initial price.' FROM known WHERE initial_price_e8 <= 0
  UNION ALL SELECT 'V22', code, item || 'has negative weight.' FROM known WHERE weight_e8 < 0
  UNION ALL SELECT 'V23', code, item || 'has invalid free-float factor.' FROM known WHERE free_float_e8 < 0 OR free_float_e8 > 100000000
  UNION ALL SELECT 'V24', code, item || 'has non-positive FX rate.' FROM known WHERE fx_rate_e8 <= 0
  UNION ALL SELECT 'V25', code, 'Index ''' || code || ''' market-cap constituent ' || instrument_id || ' must have positive shares.' FROM known WHERE methodology = 'FloatAdjustedMarketCap' AND shares <= 0
  UNION ALL SELECT 'V26', code, item || 'requires FX ' || currency || '->' || index_currency || '.' FROM known k WHERE currency <> index_currency
    AND (trim(currency) = '' OR trim(index_currency) = '' OR NOT EXISTS (SELECT 1 FROM fx WHERE f = k.currency AND t = k.index_currency))
  UNION ALL SELECT 'V27', code, 'Index ''' || code || ''' weighted-price constituents must sum to 100000000; actual=' || sum(greatest(weight_e8, 0)) || '.' FROM of_index WHERE methodology = 'WeightedPrice' GROUP BY index_id, code HAVING sum(greatest(weight_e8, 0)) <> 100000000)""",
)
def refdata_errors(spark, sf_dir):
    """All rules: those of the tables' faulty snapshot, and those of an empty one without a version."""
    broken = (reference.instruments(spark, sf_dir), reference.indexes(spark, sf_dir), reference.constituents(spark, sf_dir), reference.fx_rates(spark, sf_dir))
    empty = [df.limit(0) for df in broken]
    return refdata.validate(1, 1, *broken).union(refdata.validate(0, 1, *empty))


@query("codec_roundtrip", "SELECT arrival, sequence, instrument_id, exchange_id, price_e8, quantity, exchange_ts_nanos, receive_ts_nanos, partition, flags, 47 AS size FROM ticks", "ticks")
def codec_roundtrip(spark, sf_dir):
    framed = ticks.clean_ticks(spark, sf_dir).select("arrival", codec.encode(codec.TICK).alias("frame"))
    return framed.select("arrival", codec.decode(F.col("frame"), codec.TICK).alias("t"), F.octet_length("frame").alias("size")).select("arrival", "t.*", "size")


@query("index_value_codec", "SELECT index_id, sequence, value_e8, level_e8, timestamp_nanos, constituent_count, 0 AS stale_constituent_count FROM levels", "levels")
def index_value_codec(spark, sf_dir):
    values = index_values.value_path(_applied(spark, sf_dir), catalog.constituents(spark)).withColumn("stale_constituent_count", F.lit(0))
    return values.select(codec.decode(codec.encode(codec.INDEX_VALUE), codec.INDEX_VALUE).alias("v")).select("v.*")


def _big(value: F.Column, size: int) -> F.Column:
    digits = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size))
    return F.unhex(digits)


def _zeros(n: int) -> F.Column:
    return F.unhex(F.lit("00" * n))


def _feed(spark: SparkSession, sf_dir: str, protocol: str, message: F.Column) -> DataFrame:
    sent = ticks.clean_ticks(spark, sf_dir).withColumn("cents", F.floor(F.col("price_e8") / 1_000_000)).withColumn("traded", F.col("arrival") % 20 != 0)
    rows = sent.select(F.col("arrival").alias("message_id"), message.alias("message"), "receive_ts_nanos")
    symbols = catalog.local(spark, [(key, i, i & 3) for i in range(1, 8) for key in (str(i), f"SYM{i}")], "symbol_key string, instrument_id int, partition int")
    return wire.parse(rows, protocol, symbols).drop("flags")


_FEED_ORACLE = """SELECT arrival AS message_id, {sequence} AS sequence, instrument_id, {exchange}::SMALLINT AS exchange_id, (price_e8 // 1000000 * 1000000)::BIGINT AS price_e8, quantity, {ts} AS exchange_ts_nanos, receive_ts_nanos, partition
FROM ticks WHERE arrival % 20 <> 0 AND instrument_id <= 7"""


def _feed_oracle(exchange: int, sequence: str, ts: str) -> str:
    return _FEED_ORACLE.format(exchange=exchange, sequence=sequence, ts=ts)


@query("feed_itch", _feed_oracle(1, "sequence", "exchange_ts_nanos % 86400000000000"), "ticks")
def feed_itch(spark, sf_dir):
    kind = F.when(F.col("traded"), F.unhex(F.lit("50"))).otherwise(F.unhex(F.lit("53")))
    message = F.concat(kind, _big(F.col("instrument_id"), 2), _zeros(2), _big(F.col("exchange_ts_nanos") % 86_400_000_000_000, 6), _big(F.col("sequence"), 8), _zeros(1), _big(F.col("quantity"), 4), _zeros(8), _big(F.col("cents") * 100, 4), _zeros(8))
    return _feed(spark, sf_dir, "itch", message)


@query("feed_xdp", _feed_oracle(3, "sequence", "exchange_ts_nanos % 1000000000"), "ticks")
def feed_xdp(spark, sf_dir):
    kind = codec.integer(F.when(F.col("traded"), 220).otherwise(171), 2)
    message = F.concat(_zeros(2), kind, codec.integer(F.col("exchange_ts_nanos") % 1_000_000_000, 4), _zeros(2), codec.integer(F.col("instrument_id"), 4), codec.integer(F.col("sequence"), 4), _zeros(8), codec.integer(F.col("quantity"), 4), codec.integer(F.col("cents") * 10, 4), _zeros(8))
    return _feed(spark, sf_dir, "xdp", message)


@query("feed_pitch", _feed_oracle(4, "0::BIGINT", "exchange_ts_nanos % 86400000000000"), "ticks")
def feed_pitch(spark, sf_dir):
    kind = F.when(F.col("traded"), F.unhex(F.lit("2C"))).otherwise(F.unhex(F.lit("21")))
    symbol = F.encode(F.rpad(F.concat(F.lit("SYM"), F.col("instrument_id").cast("string")), 6, " "), "US-ASCII")
    message = F.concat(_zeros(1), kind, _big(F.col("exchange_ts_nanos") % 86_400_000_000_000, 6), _zeros(9), _big(F.col("quantity"), 4), symbol, _big(F.col("cents") * 100, 8), _zeros(4))
    return _feed(spark, sf_dir, "pitch", message)


@query("feed_cme", _feed_oracle(2, "sequence", "exchange_ts_nanos"), "ticks")
def feed_cme(spark, sf_dir):
    def entry(kind: int, security: F.Column) -> F.Column:
        return F.concat(codec.integer(F.col("cents"), 8), codec.integer(F.lit(-2), 1), codec.integer(F.col("quantity"), 4), codec.integer(security, 4), codec.integer(F.col("sequence"), 4), _zeros(5), codec.integer(F.lit(kind), 1), _zeros(1))

    wanted = F.when(F.col("traded"), entry(0x32, F.col("instrument_id"))).otherwise(entry(0x31, F.col("instrument_id")))
    message = F.concat(codec.integer(F.lit(9), 2), codec.integer(F.lit(50), 2), _zeros(4), codec.integer(F.col("exchange_ts_nanos"), 8), _zeros(1), codec.integer(F.lit(28), 2), codec.integer(F.lit(3), 1), entry(0x30, F.col("instrument_id")), entry(0x32, F.lit(999)), wanted)
    return _feed(spark, sf_dir, "cme", message)


def _alarm_sql(points: str, seconds: int, periods: int, value: str, threshold: float) -> str:
    return f"""SELECT period, value, value > {threshold} AS breaching, count(*) FILTER (WHERE value > {threshold}) OVER (ORDER BY period RANGE BETWEEN {periods - 1} PRECEDING AND CURRENT ROW) >= {periods} AS alarm
FROM (SELECT (receive_ts_nanos // 1000) // {seconds * 1_000_000} AS period, {value} AS value FROM {points} GROUP BY 1)"""


@query("alarm_gaps", _alarm_sql("reported", 300, 1, "count(*) FILTER (WHERE status = 'gap')::DOUBLE", 0), "reported")
def alarm_gaps(spark, sf_dir):
    alarm = next(a for a in metrics.ALARMS if a.name == "sequence-gaps")
    points = gates.report(ticks.faulty_ticks(spark, sf_dir)).withColumn("micros", F.floor(F.col("receive_ts_nanos") / 1000))
    return metrics.alarm_states(points, alarm, "micros", (F.col("status") == gates.GAP).cast("int"))


@query("alarm_stale_rate", _alarm_sql("results", 300, 2, "count(*) FILTER (WHERE result = 'stale') * 100.0::DOUBLE / count(*)", 1.0), "results")
def alarm_stale_rate(spark, sf_dir):
    alarm = next(a for a in metrics.ALARMS if a.name == "stale-rate")
    points = _results(spark, sf_dir).withColumn("micros", F.floor(F.col("receive_ts_nanos") / 1000))
    return metrics.alarm_states(points, alarm, "micros", F.coalesce((F.col("result") == "stale").cast("int"), F.lit(0)), of=F.lit(1))


@query("dead_letter", "SELECT arrival, (arrival // 4 % 2 = 0) AS short FROM ticks WHERE arrival // 4 % 61 = 0", "ticks")
def dead_letter(spark, sf_dir):
    event = (F.col("arrival") / 4).cast("bigint")
    bad = event % 61 == 0
    framed = ticks.clean_ticks(spark, sf_dir).withColumn("event", event).withColumn("instrument_id", F.when(bad, 0).otherwise(F.col("instrument_id")))
    frame = codec.encode(codec.TICK)
    frames = framed.select(F.col("arrival").alias("offset"), F.when(bad & (F.col("event") % 2 == 0), F.substring(frame, 1, 40)).otherwise(frame).alias("value"))
    return split_dead_letters(decode_frames(frames))[1].select("arrival", (F.octet_length("frame") < 47).alias("short"))


@query(
    "snapshot_messages",
    """, s AS (SELECT index_id, instrument_id, arg_max(price_e8, arrival) AS p FROM moved GROUP BY ALL)
SELECT index_id, instrument_id, coalesce(p, initial_price_e8)::BIGINT AS latest_price_e8, weight_e8 FROM constituents LEFT JOIN s USING (index_id, instrument_id)""",
    "moved",
)
def snapshot_messages(spark, sf_dir):
    """Snapshots as JSON messages, an empty older one of each index among them, and read back."""
    snap = latest.snapshot(gates.report(ticks.faulty_ticks(spark, sf_dir)), catalog.constituents(spark))
    older = snap.withColumn("instrument_ids", F.array().cast("array<int>"))
    sent = messages.to_messages(snap.withColumn("offset", F.lit(2)), "index_id", "offset").union(messages.to_messages(older.withColumn("offset", F.lit(1)), "index_id", "offset"))
    read = messages.from_messages(messages.last_messages(sent), messages.SNAPSHOT_SCHEMA)
    return read.select("index_id", F.inline(F.arrays_zip(F.col("instrument_ids").alias("instrument_id"), F.col("latest_prices_e8").alias("latest_price_e8"), F.col("weights_e8").alias("weight_e8"))))


@query(
    "replayed_ticks",
    "SELECT partition, count(*) AS n FROM (SELECT *, CASE WHEN partition = 3 THEN 0 ELSE 40 * partition + 101 END AS start FROM ticks) WHERE arrival >= start GROUP BY partition",
    "ticks",
)
def replayed_ticks(spark, sf_dir):
    """Partitions are read again past the least offset of two snapshots, and from the beginning where there is none."""
    snaps = catalog.local(spark, [([100, 140, 180, -1],), ([900, 940, 980, -1],)], "partition_offsets array<bigint>")
    return messages.replayed(ticks.raw_ticks(spark, sf_dir), snaps).groupBy("partition").agg(F.count("*").alias("n"))


@query(
    "latency_samples",
    "SELECT arrival, greatest(1000000000000000000 + arrival - receive_ts_nanos, 0) AS processing_nanos, greatest(1000000000000000000 + arrival - exchange_ts_nanos, 0) AS e2e_nanos FROM ticks WHERE arrival % 128 = 0",
    "ticks",
)
def latency_samples(spark, sf_dir):
    measured = messages.latency_measures(ticks.raw_ticks(spark, sf_dir), F.lit(1_000_000_000_000_000_000) + F.col("arrival"))
    return messages.latency_samples(measured, 128).select("arrival", "processing_nanos", "e2e_nanos")


@query(
    "batch_samples",
    """, b AS (SELECT arrival // 400 AS batch, count(*) AS n, arg_min(arrival, arrival) FILTER (WHERE status <> 'duplicate') AS arrival, row_number() OVER (ORDER BY arrival // 400) AS i FROM reported GROUP BY arrival // 400),
c AS (SELECT 0::BIGINT AS i, 0::BIGINT AS count, false AS sampled UNION ALL SELECT b.i, CASE WHEN count + n >= 250 THEN 0 ELSE count + n END, count + n >= 250 FROM c JOIN b ON b.i = c.i + 1)
SELECT batch, b.arrival, instrument_id, greatest(1000000000000000000 + b.arrival * 8000000 - receive_ts_nanos, 0) AS processing_nanos FROM b JOIN c USING (i) JOIN reported r ON r.arrival = b.arrival WHERE sampled""",
    "reported",
    recursive=True,
)
def batch_samples(spark, sf_dir):
    """Ticks come in batches of 400 arrivals; about one batch in three is sampled."""
    gated = gates.report(ticks.faulty_ticks(spark, sf_dir)).withColumn("batch", F.call_function("div", "arrival", F.lit(400)))
    measured = messages.latency_measures(sampling.batch_samples(gated, "batch", 250), F.lit(1_000_000_000_000_000_000) + F.col("arrival") * 8_000_000)
    return measured.select("batch", "arrival", "instrument_id", "processing_nanos")


def _alarm(name: str, points: Callable[[SparkSession, str], DataFrame], value: str, sql_points: str, sql_value: str, needs: str) -> None:
    """An alarm over what the engine measures: ``points`` has receive_ts_nanos and what ``value`` names."""
    alarm = next(a for a in metrics.ALARMS if a.name == name)
    lead = f", points AS ({sql_points})" + "\n"

    @query(f"alarm_{name.replace('-', '_')}" if name != "processing-p99" else "alarm_latency", lead + _alarm_sql("points", alarm.seconds, alarm.periods, sql_value, alarm.threshold), needs)
    def states(spark: SparkSession, sf_dir: str) -> DataFrame:
        timed = points(spark, sf_dir).withColumn("micros", F.call_function("div", "receive_ts_nanos", F.lit(1000)))
        return metrics.alarm_states(timed, alarm, "micros", F.expr(value))


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied ticks with their latencies: a tick that waits for a hole is applied when the tick that fills it is received."""
    gated = gates.applied(gates.buffer_unbounded(ticks.faulty_ticks(spark, sf_dir)))
    filler = gated.where(F.col("status") == gates.ACCEPTED).select(F.col("arrival").alias("o1"), F.col("receive_ts_nanos").alias("now"))
    return messages.latency_measures(gated.join(filler, "o1"), F.col("now"))


_RELEASED_SQL = """WITH f AS (SELECT *, first_value(sequence) OVER (PARTITION BY instrument_id ORDER BY arrival) AS fs, row_number() OVER (PARTITION BY instrument_id, sequence ORDER BY arrival) AS cp FROM faulty),
  v AS (SELECT *, row_number() OVER w AS place, max(arrival) OVER w AS filled FROM f WHERE cp = 1 AND sequence >= fs WINDOW w AS (PARTITION BY instrument_id ORDER BY sequence ROWS UNBOUNDED PRECEDING))
  SELECT v.receive_ts_nanos, greatest(n.receive_ts_nanos - v.receive_ts_nanos, 0) AS processing, CASE WHEN v.exchange_ts_nanos > 0 THEN greatest(n.receive_ts_nanos - v.exchange_ts_nanos, 0) END AS e2e
  FROM v JOIN v n ON n.arrival = v.filled WHERE v.sequence - v.fs = v.place - 1"""

_alarm("processing-p99", _released, "processing_nanos", _RELEASED_SQL, "max(processing)::DOUBLE", "faulty")
_alarm("e2e-p99", _released, "e2e_nanos", _RELEASED_SQL, "max(e2e)::DOUBLE", "faulty")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.report(ticks.faulty_ticks(spark, sf_dir))


_alarm("duplicates", _reported, "int(status = 'duplicate')", "SELECT * FROM reported", "count(*) FILTER (WHERE status = 'duplicate')::DOUBLE", "reported")
_alarm("calculation-failures", _results, "int(coalesce(result = 'failed', false))", "SELECT * FROM results", "count(*) FILTER (WHERE result = 'failed')::DOUBLE", "results")


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters at the time when their frames were received, beside all other frames."""
    bad = F.col("arrival") % 244 == 0
    framed = ticks.clean_ticks(spark, sf_dir).withColumn("received", F.col("receive_ts_nanos")).withColumn("instrument_id", F.when(bad, 0).otherwise(F.col("instrument_id")))
    frames = framed.select(F.col("received").alias("offset"), codec.encode(codec.TICK).alias("value"))
    good, dead = split_dead_letters(decode_frames(frames))
    return good.select("arrival", F.lit(0).alias("dropped")).union(dead.select("arrival", F.lit(1))).withColumnRenamed("arrival", "receive_ts_nanos")


_alarm("dropped", _dead, "dropped", "SELECT receive_ts_nanos, arrival % 244 = 0 AS dropped FROM ticks", "count(*) FILTER (WHERE dropped)::DOUBLE", "ticks")


def _lags(topic: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lags as the clients' statistics report them, a document an event."""

    def points(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = ticks.raw_ticks(spark, sf_dir)
        document = F.format_string('{"topics":{"ticks.raw":{"partitions":{"0":{"consumer_lag":%d},"1":{"consumer_lag":40},"-1":{"consumer_lag":99}}},"index.deltas":{"partitions":{"0":{"consumer_lag":%d}}}}}', F.col("quantity") * 150, F.col("quantity") * 60 - 1)
        return latest.consumer_lag(raw.select(F.col("receive_ts_nanos").alias("id"), document.alias("json")), topic).withColumnRenamed("id", "receive_ts_nanos")

    return points


_alarm("consumer-lag", _lags("ticks.raw"), "consumer_lag", "SELECT receive_ts_nanos, quantity * 150 + 40 AS lag FROM ticks", "max(lag)::DOUBLE", "ticks")
_alarm("publisher-lag", _lags("index.deltas"), "consumer_lag", "SELECT receive_ts_nanos, greatest(quantity * 60 - 1, 0) AS lag FROM ticks", "max(lag)::DOUBLE", "ticks")


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that came in less those that an index took, after each tick."""
    came = _results(spark, sf_dir).select(F.lit(0).alias("engine"), F.col("arrival").alias("o1"), F.lit(0).alias("o2"), "receive_ts_nanos", F.when(F.col("result") == "applied", 0).otherwise(1).cast("bigint").alias("left"))
    return blocks.running(came, ["engine"], {"depth": (blocks.SUM, F.col("left"))}, before=False)


_alarm("ring-depth", _depths, "depth", "SELECT receive_ts_nanos, sum(CASE WHEN result = 'applied' THEN 0 ELSE 1 END) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS depth FROM results", "max(depth)::DOUBLE", "results")
