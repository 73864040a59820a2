"""Micro-batches give what a batch gives, and a restarted query goes on where it stopped."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from indexloom.operators import actions, gates, latest, metrics, sampling
from indexloom.sources import synthetic, ticks
from indexloom.streaming import alarms, engine, messages, tables

SF = "/root/testdata/sf0.001"


def test_gated_stream_equals_batch(spark, tmp_path):
    root, check, out = str(tmp_path / "root"), str(tmp_path / "check"), str(tmp_path / "out")
    faulty = ticks.faulty_ticks(spark, SF).where("arrival < 2000").coalesce(1).cache()

    def run():
        good, _ = engine.split_dead_letters(engine.read_frames(spark, root))
        gated = engine.gate_stream(good, gates.BUFFER).select("arrival", "sequence", "instrument_id", "status", "o1", "o2")
        query = gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    for a, z in ((0, 700), (700, 1300)):
        engine.write_frames(faulty.where(f"arrival >= {a} AND arrival < {z}"), root)
    run()
    engine.write_frames(faulty.where("arrival >= 1300"), root)
    run()  # a new query from the checkpoint
    columns = ["arrival", "sequence", "instrument_id", "status", "o1", "o2"]
    want = gates.gate(faulty, gates.BUFFER).where("status <> 'pending'").select(*columns).collect()
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == sorted(map(tuple, want)) if all(r.o1 is not None for r in want) else sorted(map(repr, spark.read.parquet(out).select(*columns).collect())) == sorted(map(repr, want))


def test_dead_letters(spark):
    short, zero = bytes(10), bytes(47)
    frames = spark.createDataFrame([(0, short), (1, zero), (2, bytes(8) + b"\x01" + bytes(38))], "offset bigint, value binary")
    good, dead = engine.split_dead_letters(engine.decode_frames(frames))
    assert [r.arrival for r in good.collect()] == [2] and sorted(r.arrival for r in dead.collect()) == [0, 1]


def test_latest_values_sink(spark, tmp_path):
    source, out = str(tmp_path / "values"), str(tmp_path / "latest")
    schema = "index_id int, sequence bigint, value_e8 bigint, arrival bigint"
    for rows in ([(1, 1, 10, 1), (1, 2, 20, 2)], [(1, 1, 99, 3), (2, 1, 5, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    engine.keep_latest(stream, out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    table = tables.KeyedTable(spark, out, "index_id", "index_id int, sequence bigint, value_e8 bigint")
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 2, 20), (2, 1, 5)]


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "index_id int, sequence bigint, value_e8 bigint"
    table = tables.KeyedTable(spark, str(tmp_path / "t"), "index_id", schema, buckets=4)
    batch = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], f"{schema}, arrival bigint")
    stored = lambda: sorted(map(tuple, table.read().collect()))
    assert stored() == []
    table.merge(batch([(i, 1, i) for i in range(20)]), 0, latest.upsert)
    first = table.current()
    table.merge(batch([(3, 2, 33), (3, 1, 99)][:1]), 1, latest.upsert)
    want = sorted([(i, 1, i) for i in range(20) if i != 3] + [(3, 2, 33)])
    assert stored() == want and sum(first[b] != f for b, f in table.current().items()) == 1

    def fails(old, new):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        table.merge(batch([(4, 9, 9)]), 2, fails)
    assert stored() == want
    (tmp_path / "t" / "batch=2" / "__bucket=0").mkdir(parents=True)  # what a lost batch may leave
    for number in range(2, 8):  # a batch that is run again replaces itself
        table.merge(batch([(5, number, number)]), number, latest.upsert)
        table.merge(batch([(5, number, number)]), number, latest.upsert)
    assert stored() == sorted([r for r in want if r[0] != 5] + [(5, 7, 7)])
    files = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert len(files) <= 4 * 4 and len(list((tmp_path / "t").glob("*.pointer"))) == 1


def test_synthetic_stream(spark, tmp_path):
    spark.dataSource.register(synthetic.SyntheticTicks)
    stream = spark.readStream.format("synthetic_ticks").option("rows", 50).load()
    query = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(200):
            if spark.table("feed").count() >= 150:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    n = spark.table("feed").count()
    batch = spark.read.format("synthetic_ticks").option("rows", n).load()
    assert n >= 150 and spark.table("feed").select("arrival", "price_e8").exceptAll(batch.select("arrival", "price_e8")).isEmpty()


def test_actions_go_to_both_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 100, 1, "WeightChange", 5)], "o1 bigint, index_id smallint, instrument_id int, type string, new_weight_e8 bigint")
    engine.publish_actions(rows, str(tmp_path))
    texts = [spark.read.parquet(engine.stream_path(str(tmp_path), n)).select(F.get_json_object("value", "$.newWeightE8")).first()[0] for n in ("corporate.actions", "index.audit")]
    assert texts == ["5"] * 2


def test_snapshots_actions_and_replay_as_messages(spark, tmp_path):
    root = str(tmp_path)
    rows = [(100, s, 5, 2.5, [1, 2], [3, 4], [5, 6], [7, 8], [9, 10], 11, [40, -1]) for s in (1, 2)] + [(101, 1, 5, 2.5, [], [], [], [], [], 11, [20, -1])]
    snaps = spark.createDataFrame(rows, messages.SNAPSHOT_SCHEMA)
    for number in (1, 2):
        messages.write_snapshots(snaps.where(f"sequence = {number}"), root, number)
    spark.createDataFrame([("102", 9, "no json")], "key string, offset long, value string").write.mode("append").parquet(f"{root}/index.snapshots")
    assert '"latestPricesE8":[3,4]' in messages.read_messages(spark, root, "index.snapshots").where("key = '100'").first().value
    got = messages.read_snapshots(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, snaps.where("index_id = 101 OR sequence = 2").collect()))
    ticks = spark.createDataFrame([(p, a) for p in (0, 1, 2) for a in (0, 20, 21, 41)], "partition int, arrival long")
    assert sorted(map(tuple, messages.replayed(ticks, got).collect())) == [(0, 21), (0, 41), *[(p, a) for p in (1, 2) for a in (0, 20, 21, 41)]]
    acts = spark.createDataFrame([(40, 100, 1, "WeightChange", 7), (41, 101, 2, "ConstituentRemoval", None)], actions.ACTION_SCHEMA)
    engine.publish_actions(acts, root)
    assert sorted(map(tuple, messages.read_actions(spark, root).collect())) == sorted(map(tuple, acts.collect()))
    query = messages.read_actions(spark, root, stream=True).writeStream.format("memory").queryName("acts").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("acts").count() == 2
    state = messages.checkpoint_state(query, 4_000_000_000_000)
    assert state["age_millis"] > 0 and state["state_rows"] == 0


@pytest.mark.parametrize(("rate", "block"), [(1, 4), (7, 4), (50, 3), (128, 1 << 14), (0, 4)])
def test_sampled_batches_equal_a_counter(spark, rate, block):
    rnd = random.Random(rate)
    sizes = [(i, rnd.choice([0, 1, 3, 40])) for i in range(200) if rnd.random() < 0.9]
    count, want = 0, []
    for i, n in sizes:
        count += n
        hit = rate > 0 and count >= rate
        count = 0 if hit else count
        want.append((i, n, hit))
    rnd.shuffle(sizes)
    got = sampling.sampled_batches(spark.createDataFrame(sizes, "batch long, n long"), rate, block).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["duplicates", "stale-rate", "ring-depth"])
def test_alarms_over_a_stream_equal_those_of_a_table(spark, tmp_path, name):
    """Over several micro-batches, with periods without points; the last periods stay open."""
    alarm = next(a for a in metrics.ALARMS if a.name == name)
    rnd = random.Random(3)
    points, second = [], 1_700_000_000
    for _ in range(400):
        second += rnd.choice([1, 5, 20, 90] + [alarm.seconds * 2] * (rnd.random() < 0.02))
        points.append((second * 1_000_000, {"duplicates": rnd.randint(0, 40), "stale-rate": int(rnd.random() < 0.2), "ring-depth": rnd.choice([0, 40_000])}[name]))
    end = points[-1][0] + 10 * alarm.seconds * 1_000_000
    of = F.lit(1) if alarm.statistic == "rate" else None
    for a in range(0, 400, 100):
        spark.createDataFrame(points[a : a + 100], "micros long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("micros long, v long").parquet(str(tmp_path / "in"))
        query = alarms.alarm_stream(stream, alarm, "micros", F.col("v"), of).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(end, 0)], "micros long, v long").write.mode("append").parquet(str(tmp_path / "in"))  # closes what is open
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("period", "value", "breaching", "alarm").collect()
    want = metrics.alarm_states(spark.createDataFrame(points, "micros long, v long"), alarm, "micros", F.col("v"), of).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r.alarm for r in want)


def test_trigger_waits_its_interval(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "index_id int, sequence bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("index_id int, sequence bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(1, 2)], "index_id int, sequence bigint").write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        starts = [p["timestamp"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    millis = [int(datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp() * 1000) for s in starts]
    assert len(millis) == 2 and millis[1] - millis[0] >= 500 - 50
