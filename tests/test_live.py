"""The running engine equals its batch twins, whatever its micro-batches, and goes on from checkpoints and from snapshots."""

import json
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from indexloom.functions import codec
from indexloom.operators import actions as acts
from indexloom.operators import gates, latest
from indexloom.sources import catalog
from indexloom.streaming import engine, live, log, messages, meters, runtime

FRAME = "sequence bigint, instrument_id int, exchange_id smallint, price_e8 bigint, quantity int, exchange_ts_nanos bigint, receive_ts_nanos bigint, partition int, flags tinyint, offset bigint"
PARTITIONS = 2


def feed(seed, n=400, shuffled=0):
    """Ticks of eight instruments with gaps, copies, late and old ones, and some that name no instrument."""
    rnd = random.Random(seed)
    last, out = dict.fromkeys(range(1, 9), 0), []
    for i in range(n):
        instrument = rnd.randint(1, 8)
        last[instrument] += 1
        out.append([last[instrument], instrument, 1, rnd.randint(10**7, 10**10), 1, 1_700_000_000_000_000_000 + i * 1000 - (10**7 if rnd.random() < 0.05 else 0), 1_700_000_000_000_001_000 + i * 1000, instrument % PARTITIONS, 17 if rnd.random() < 0.05 else 1])
    for _ in range(shuffled):
        i = rnd.randrange(n - 6)
        out[i], out[i + rnd.randint(1, 5)] = out[i + rnd.randint(1, 5)], out[i]
    out = [t for t in out if rnd.random() > (0.01 if shuffled else 0)]
    return [(*t, i) for i, t in enumerate(out)] + [(1, 0, 1, 5, 1, 1, 1, 0, 1, len(out)), (1, 0, 1, 5, 1, 1, 1, 1, 1, len(out) + 1)]


def ticks_of(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def append(spark, folder, rows, segment=64):
    log.write_log(ticks_of(spark, rows).select("partition", "offset", codec.encode(codec.TICK).alias("value")), f"{folder}/log", PARTITIONS, segment)


def go(spark, folder, root="root", checkpoint="check", **more):
    actions = spark.readStream.schema(acts.ACTION_SCHEMA).parquet(f"{folder}/actions")
    more = {"rows": 256, "segment": 64, "trigger": "0 seconds", "clock": 2 * 10**18, "rate": 1} | more
    query = runtime.start(spark, f"{folder}/{root}", f"{folder}/log", f"{folder}/{checkpoint}", actions, catalog.constituents(spark), PARTITIONS, **more)
    runtime.drain(query)
    return query


def no_actions(spark, folder):
    catalog.local(spark, [], acts.ACTION_SCHEMA).write.parquet(f"{folder}/actions")


def state(spark, folder, root="root"):
    return sorted(map(tuple, runtime.live_state(spark, f"{folder}/{root}").drop("stale_constituent_count").collect()))


def test_micro_batches_are_bounded_and_equal_one_batch(spark, tmp_path):
    rows = feed(1, shuffled=30)
    append(spark, tmp_path, rows)
    no_actions(spark, tmp_path)
    query = go(spark, tmp_path, "small", "c1", rows=128)
    sizes = [p["numInputRows"] for p in query.recentProgress]
    assert max(sizes) <= 128 and sum(sizes) == len(rows) and len([s for s in sizes if s]) >= 3
    go(spark, tmp_path, "large", "c2", rows=1 << 20)
    assert state(spark, tmp_path, "small") == state(spark, tmp_path, "large")
    frames = spark.read.parquet(f"{tmp_path}/small/index.deltas")
    assert frames.groupBy("batch", "key").count().where("count > 1").isEmpty() and frames.where("octet_length(value) <> 42").isEmpty()
    small, large = (runtime.last_metrics(spark, f"{tmp_path}/{r}").first().asDict() for r in ("small", "large"))
    unsure = ("messages_per_second", "calc_duration_p99_nanos", "publication_duration_p99_nanos")
    assert {k: v for k, v in small.items() if k not in unsure} == {k: v for k, v in large.items() if k not in unsure}
    assert small["dropped_messages"] == 2 and small["messages_in"] == len(rows) - 2 and small["consumer_lag"] == 0
    text = json.loads(spark.read.parquet(f"{tmp_path}/small/engine.metrics").first().value)
    assert len(text) == 23 and "endToEndP99Nanos" in text


@pytest.mark.parametrize("policy", [gates.BUFFER, gates.REPORT])
def test_start_from_snapshots_equals_a_run_that_never_stopped(spark, tmp_path, policy):
    rows = feed(2, shuffled=30)
    no_actions(spark, tmp_path)
    append(spark, tmp_path, rows[:230])  # the micro-batches are small, so that waiting ticks cross them
    go(spark, tmp_path, "stopped", "c1", policy=policy)
    append(spark, tmp_path, rows[230:])
    snapshots = messages.read_snapshots(spark, f"{tmp_path}/stopped")
    starts = dict(latest.replay_offsets(snapshots).collect())
    go(spark, tmp_path, "whole", "c2", policy=policy)
    for file in pathlib.Path(tmp_path, "log").rglob("*.parquet"):  # what lies below the offsets is never opened
        segment, partition = (int(p.name.split("=")[1]) for p in list(file.parents)[:2])
        if (segment + 1) * 64 <= starts[partition]:
            file.write_bytes(b"not a file of Parquet")
            assert segment <= 3
    go(spark, tmp_path, "stopped", "c3", policy=policy, snapshots=snapshots)
    assert max(starts.values()) > 64 and state(spark, tmp_path, "stopped") == state(spark, tmp_path, "whole")
    replay = log.read_log(spark, f"{tmp_path}/log", starts, 64)
    assert replay.count() == sum(r[9] >= starts[r[7]] for r in rows)


def test_actions_take_their_place_among_ticks(spark, tmp_path):
    rows = feed(3, 300)
    actions = [(40, 100, 1, acts.REMOVAL, 0), (41, 100, 2, acts.CHANGE, 9_000_000), (150, 101, 3, acts.REMOVAL, 0), (160, 101, 3, acts.ADDITION, 5_000_000), (161, 101, 3, acts.ADDITION, 7), (250, 102, 99, acts.CHANGE, 7), (251, 102, 5, "Split", 1)]
    for a, z in ((0, 100), (100, 200), (200, 10**6)):
        append(spark, tmp_path, [r for r in rows if a <= r[9] < z])
        catalog.local(spark, [x for x in actions if a <= x[0] < z], acts.ACTION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/actions")
        go(spark, tmp_path, rows=1 << 20)  # from the checkpoint of the round before
    got = runtime.live_state(spark, f"{tmp_path}/root").join(messages.read_snapshots(spark, f"{tmp_path}/root").select("index_id", "divisor", F.col("weights_e8").alias("w")), "index_id")
    ticks = ticks_of(spark, rows).where("instrument_id > 0").withColumn("arrival", F.col("offset")).drop("offset")
    rows_of_actions = catalog.local(spark, actions, acts.ACTION_SCHEMA)
    want = acts.values_after_actions(gates.applied(gates.gate(ticks, gates.BUFFER)), catalog.constituents(spark), rows_of_actions)
    columns = ["index_id", "sequence", "value_e8", "divisor", "level_e8", "constituent_count"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    weights = {r.index_id: r.w for r in got.collect()}
    assert weights[100][:2] == [0, 9_000_000] and weights[101][2] == 5_000_000


def test_a_plan_that_was_not_begun_is_given_again(tmp_path, spark):
    append(spark, tmp_path, feed(4, 200))
    options = {"path": f"{tmp_path}/log", "plan": f"{tmp_path}/plan", "partitions": "2", "rows": "40", "segment": "64"}
    first = log.TickLogReader(options)
    end = first.latestOffset()
    assert end == {"0": 20, "1": 20} == first.latestOffset() == log.TickLogReader(options).latestOffset()
    first.partitions(first.initialOffset(), end)
    again = log.TickLogReader(options)
    assert again.latestOffset() == {"0": 40, "1": 40} and first.end_of(0) == 201
    rows = [b for p in again.partitions(end, {"0": 40, "1": 40}) for b in again.read(p)]
    assert all(20 <= o < 40 for b in rows for o in b.column(1).to_pylist()) and sum(b.num_rows for b in rows) == 20


def test_meters():
    m = meters.Metered.from_state(None)
    assert json.loads(m.row_json())["p99_latency_nanos"] == 0
    for i in range(3):
        own = meters.Meter(samples=[[3 - i, i, -1, 2]], calc_nanos=[5])
        for s in (gates.ACCEPTED, gates.DUPLICATE, gates.PENDING, gates.FULL):
            own.count(s)
        own.result(True, False)
        own.result(False, True)
        m.add(meters.Meter.from_json(own.to_json()))
    m = meters.Metered.from_state(m.state())
    row = json.loads(m.row_json())
    assert (row["messages_in"], row["messages_out"], row["duplicate_events"], row["sequence_gaps"], row["calculation_failures"], row["stale_ticks"]) == (12, 3, 3, 6, 3, 3)
    assert row["last_latency_nanos"] == 0 and row["end_to_end_p50_nanos"] == 0 and row["p50_latency_nanos"] == 1


def test_state_of_snapshots_is_that_of_constituents(spark):
    con = catalog.constituents(spark)
    snapshots = latest.snapshot(ticks_of(spark, []).select("*", F.col("offset").alias("arrival"), F.lit("accepted").alias("status"), F.lit(1).cast("long").alias("o1"), F.lit(1).cast("long").alias("o2")), con)
    for a, b in ((live.first_slots(con), live.restored_slots(snapshots)), (live.first_values(con), live.restored_values(snapshots))):
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))


def test_published_streams_are_named():
    with pytest.raises(ValueError, match="no stream"):
        engine.stream_path("root", "other")


def test_partitions_of_state_follow_instruments(spark, tmp_path):
    append(spark, tmp_path, feed(5, 20))
    no_actions(spark, tmp_path)
    before = spark.conf.get(runtime.SHUFFLE)
    spark.conf.set(runtime.SHUFFLE, "48")
    try:
        go(spark, tmp_path)
        assert spark.conf.get(runtime.SHUFFLE) == "48"
    finally:
        spark.conf.set(runtime.SHUFFLE, before)
    for operator in "01":
        stores = [p for p in pathlib.Path(tmp_path, "check", "query", "state", operator).iterdir() if p.name.isdigit()]
        assert 0 < len(stores) <= 8 * runtime.STATES


def test_ticks_are_packed_by_instrument():
    rows = [(2, 7, 1, 5, 2**60 + 1, 3, 4, 17), (1, 8, 0, 1, 1, 1, 1, 1), (2, 6, 1, 4, -9, 3, 4, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["instrument_id", *live.TICK])
    packed = [Row(instrument_id=i, kind=1, arrival=None, index_id=None, target=None, type=None, new_weight_e8=None, ticks=t) for p in live._packed([batch, batch.slice(0, 0)]) for i, t in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    assert [r.instrument_id for r in packed] == [1, 2]
    action = Row(instrument_id=2, kind=0, arrival=7, index_id=100, target=2, type=acts.REMOVAL, new_weight_e8=0, ticks=None)
    assert live._events(iter([packed[1], action])) == [(6, 1, list(rows[2][2:])), (7, 0, [100, 2, acts.REMOVAL, 0]), (7, 1, list(rows[0][2:]))]


def test_an_instrument_sends_no_more_samples_than_are_kept(monkeypatch):
    monkeypatch.setattr(live, "SAMPLES", 3)
    processor = live.InstrumentState(gates.REPORT, 8, 1, 2 * 10**18)
    held = type("Value", (), {"get": lambda self: None, "update": lambda self, v: None, "iterator": lambda self: iter([((100,), (10**7, 5, 0))]), "updateValue": lambda self, k, v: None})()
    processor.gate = processor.slots = held
    ticks = np.array([(i, 1, i + 1, 5, 10, 20, 1) for i in range(9)], "<i8").tobytes()
    out = list(processor.handleInputRows((1,), iter([Row(instrument_id=1, kind=1, arrival=None, index_id=None, target=None, type=None, new_weight_e8=None, ticks=ticks)]), None))
    meter = meters.Meter.from_json(next(r.meter for r in out if r.kind == live.METER))
    assert meter.messages_in == 9 and [s[0] for s in meter.samples] == [6, 7, 8]
