"""Goldens, and equality with sequential folds on random streams."""

import pathlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from indexloom.functions import codec, fixed, wire
from indexloom.operators import actions, blocks, durable, gates, index_values, latest, metrics, refdata
from indexloom.plans import live, market  # noqa: F401  the first adds its queries to the second
from indexloom.sources import catalog, reference, synthetic

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TICK = "arrival bigint, sequence bigint, instrument_id int, price_e8 bigint, exchange_ts_nanos bigint, receive_ts_nanos bigint, flags int"


def tick(arrival, sequence, price, ts, instrument=1, flags=1):
    return (arrival, sequence, instrument, price, ts, ts + 1000, flags)


def frame(spark, rows):
    return spark.createDataFrame(rows, TICK)


def as_set(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([None if v is None else round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in at)]) for r in rows)


@pytest.mark.parametrize("name", sorted(market.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.execute(market.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = market.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert as_set(got.columns, [tuple(r) for r in got.collect()]) == as_set(columns, want.fetchall())


NO_SEQUENCE = ["throughput", "fanout_factor", "latency_samples", "replay_offsets", "fanout_percentiles"]


def written(spark):
    """Bytes below the checkpoint folder."""
    return sum(p.stat().st_size for p in pathlib.Path(durable.checkpoint_dir(spark)).rglob("*") if p.is_file())


@pytest.mark.parametrize("name", ["index_value_path", "index_value_latest", "latest_upsert", "corporate_action_path", "snapshot_slots", "counters", "restore_replay", "latency_percentiles", *NO_SEQUENCE])
def test_queries_write_summaries_only(spark, name):
    """However many running values are stacked, what is written is small against the table, and a plan reads it a few times at most."""
    before = written(spark)
    got = market.QUERIES[name](spark, "/root/testdata/sf0.01")
    got.collect()
    assert written(spark) - before <= (0 if name in NO_SEQUENCE else 0.2 * pathlib.Path("/root/testdata/sf0.01/events.parquet").stat().st_size)
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert 1 <= final.count("FileScan parquet") <= 2 or name in ("latest_upsert",)


def test_gate_and_running_values_share_a_shuffle(spark):
    """Duplicates, stale ticks and previous prices of an instrument are found in one layout."""
    ticks_ = spark.range(1000).select(F.col("id").alias("arrival"), (F.col("id") % 7).alias("instrument_id"), F.col("id").alias("sequence"), F.col("id").alias("price_e8"), F.col("id").alias("exchange_ts_nanos"))
    judged = index_values.judge(gates.applied(gates.report(ticks_)))
    judged.collect()
    plan = judged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(instrument_id#\d+L?, __block", plan)) == 1 and plan.count("Range (") == 1  # others are of summaries


@pytest.mark.parametrize("n", [1, 10, 37, 10_000])
def test_last_rows_by_blocks(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("ab"), o) for o in rnd.sample(range(2000), 300)]
    got = metrics.last_rows(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", n, block=64).collect()
    want = [r for k in "ab" for r in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])[:n]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_running_values_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDE", 3)
    rnd = random.Random(3)
    rows = [(k, o1, o2, rnd.choice([None, rnd.randrange(100)])) for k in (1, 2) for o1 in range(0, 60, 2) for o2 in (0, 1)]
    wanted = {"top": (blocks.MAX, F.col("v")), "latest": (blocks.LAST, F.col("v")), "total": (blocks.SUM, F.col("v"))}
    got = blocks.running(spark.createDataFrame(rows, "k int, o1 long, o2 int, v int"), ["k"], wanted, block=2).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, o1, o2, v in rows if k == r.k and (o1, o2) < (r.o1, r.o2) and v is not None]
        assert (r.top, r.latest, r.total) == (max(before, default=None), before[-1] if before else None, sum(before))


def test_restore_replay_above_100_000_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("event_id", F.col("event_id") * 150).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert db.execute("SELECT max(event_id) > 100_000 AND count(*) FILTER (WHERE event_id BETWEEN 100_000 AND 101_999) > 0 FROM events").fetchone()[0]
    want = db.execute(market.ORACLES["restore_replay"])
    columns = [c[0] for c in want.description]
    got = market.QUERIES["restore_replay"](spark, str(tmp_path))
    assert as_set(got.columns, [tuple(r) for r in got.collect()]) == as_set(columns, want.fetchall())


def test_base_values(spark):
    got = {r.index_id: (r.base_e8, r.divisor) for r in index_values.base_values(catalog.constituents(spark)).collect()}
    assert got == {100: (5_228_625_000, 5_228_625.0), 101: (6_874_200_000, 6_874_200.0), 102: (2_525_750_000, 2_525_750.0)}


def latest_of(spark, rows, gate=gates.report):
    values = index_values.latest_values(gates.applied(gate(frame(spark, rows))), catalog.constituents(spark))
    return {r.index_id: r for r in values.collect()}


def test_first_tick(spark):
    got = latest_of(spark, [tick(1, 1, 9_400_000_000, 1000)])[100]
    assert (got.value_e8, got.level_e8, got.sequence) == (5_246_625_000, 100_344_258_767, 1)


def test_truncation_follows_the_path(spark):
    prices = [78_000_005, 78_000_010, 78_000_013, 78_000_014, 78_000_027]
    rows = frame(spark, [tick(i, i, p, i, instrument=2) for i, p in enumerate(prices, 1)])
    ordered = index_values.in_order(rows)
    one = spark.createDataFrame([(1, 2, 7_500_000, 78_000_000)], "index_id smallint, instrument_id int, weight_e8 bigint, initial_price_e8 bigint")
    assert index_values.latest_values(ordered, one).first().value_e8 == 5_850_000
    assert index_values.recomputed_values(ordered, one).first().value_e8 == 5_850_002


@pytest.mark.parametrize(
    "policy, rows, statuses",
    [
        (gates.REPORT, [(1, 1), (2, 1)], ["accepted", "duplicate"]),
        (gates.REPORT, [(1, 1), (2, 3)], ["accepted", "gap"]),
        (gates.BUFFER, [(1, 1), (2, 3), (3, 2)], ["accepted", "recovered", "accepted"]),
        (gates.BUFFER, [(1, 1), (2, 3)], ["accepted", "pending"]),
        (gates.BUFFER, [(1, 5), (2, 6)], ["accepted", "accepted"]),
        (gates.BUFFER, [(1, 0), (2, 2)], ["accepted", "pending"]),
        (gates.DROP, [(1, 1), (2, 3), (3, 2)], ["accepted", "dropped", "accepted"]),
    ],
)
def test_gap_policies(spark, policy, rows, statuses):
    got = gates.gate(frame(spark, [tick(a, s, 9_400_000_000, a) for a, s in rows]), policy)
    assert [r.status for r in got.orderBy("arrival").collect()] == statuses


def test_full_buffer(spark):
    rows = [tick(1, 1, 1, 1), *[tick(a, a + 1, 1, a) for a in range(2, 12)], tick(20, 2, 1, 20)]
    got = {r.sequence: (r.status, r.o1, r.o2) for r in gates.gate(frame(spark, rows)).collect()}
    assert [got[s][0] for s in (3, 10, 11, 12)] == ["recovered", "recovered", "full", "full"]
    assert got[10] == ("recovered", 20, 8)


def fold(rows, policy, capacity):
    """The order of application of (arrival, sequence) pairs of one instrument, one after another."""
    last, held, out, counts = -1, {}, [], {"dup": 0, "gap": 0, "full": 0}
    for arrival, s in sorted(rows):
        if s > 0 and last >= 0 and s <= last or s in held:
            counts["dup"] += 1
            continue
        if s > 0 and last >= 0 and s > last + 1:
            counts["gap"] += 1
            if policy == "buffer" and len(held) < capacity:
                held[s] = arrival
            elif policy == "buffer":
                counts["full"] += 1
            elif policy == "report":
                last = s
                out.append((arrival, s))
            continue
        last = max(last, s)
        out.append((arrival, s))
        while last + 1 in held:
            last += 1
            out.append((held.pop(last), last))
    return out, counts


@pytest.mark.parametrize("seed", range(3))
def test_gates_equal_a_fold(spark, seed):
    rnd = random.Random(seed)
    rows, arrival = [], 0
    by = {}
    for instrument in range(1, 6):
        order = [s for s in range(1, 80) if rnd.random() > 0.05]
        order += rnd.sample(order, 6)
        order.sort(key=lambda s: s + rnd.random() * rnd.choice([0, 0, 6]))
        by[instrument] = []
        for s in order:
            arrival += 1
            by[instrument].append((arrival, s))
            rows.append(tick(arrival, s, 1, arrival, instrument))
    for policy, capacity in (("buffer", 3), ("buffer", 8), ("buffer", 10_000), ("drop", 8), ("report", 8)):
        got = gates.gate(frame(spark, rows), policy, capacity)
        order = {}
        for r in gates.applied(got).orderBy("o1", "o2").collect():
            order.setdefault(r.instrument_id, []).append((r.arrival, r.sequence))
        counts = {r.instrument_id: r for r in gates.gate_counts(got).collect()}
        for i, own in by.items():
            want, n = fold(own, policy, capacity)
            assert order[i] == want
            assert (counts[i].duplicates, counts[i].sequence_gaps, counts[i].buffer_full) == (n["dup"], n["gap"], n["full"])
    window = {r.arrival: (r.status, r.o1) for r in gates.buffer_unbounded(frame(spark, rows)).collect()}
    walked = {r.arrival: (r.status, r.o1) for r in gates.gate(frame(spark, rows), "buffer", 10_000).collect()}
    late_first = {a for a, (status, _) in window.items() if status != walked[a][0]}
    assert {window[a][1] for a in window if a not in late_first} == {walked[a][1] for a in walked if a not in late_first}
    assert gates.report(frame(spark, rows)).select("arrival", "status").exceptAll(gates.gate(frame(spark, rows), "report").select("arrival", "status")).isEmpty()


def walk(rows, acts):
    """Values of index 100, 101 and 102 after ticks and actions, one after another."""
    state = {}
    for x, weights in catalog.WEIGHTS.items():
        prices = {i: p for i, _, p in catalog.INSTRUMENTS}
        slots = {i: [prices[i], w, 0] for i, w in weights.items()}
        v = sum(int(p * w // fixed.SCALE) for p, w, _ in slots.values())
        state[x] = [v, v / 1000.0, 0, len(slots), slots]
    trunc = lambda n: abs(n) // fixed.SCALE * (1 if n >= 0 else -1)
    events = [(o, -1, a) for o, *a in acts] + [(r[0], 0, r) for r in rows]
    for _, kind, e in sorted(events, key=lambda e: e[:2]):
        if kind == 0:
            _, _, instrument, price, ts, _, _ = e
            for s in state.values():
                slot = s[4].get(instrument)
                if slot and slot[1] and ts >= slot[2]:
                    s[0] += trunc((price - slot[0]) * slot[1])
                    slot[0], slot[2] = price, ts
                    s[2] += 1
        else:
            x, instrument, what, weight = e
            s = state[x]
            slot = s[4].get(instrument)
            if slot is None or what not in (actions.CHANGE, actions.ADDITION, actions.REMOVAL) or (what == actions.ADDITION and slot[1]):
                continue
            weight = 0 if what == actions.REMOVAL else weight
            after = s[0] - trunc(slot[0] * slot[1]) + trunc(slot[0] * weight)
            s[1] = float(after) * s[1] / float(s[0]) if s[0] > 0 else after / 1000.0
            s[0], slot[1] = after, weight
            s[2] += 1
            s[3] += {actions.ADDITION: 1, actions.REMOVAL: -1}.get(what, 0)
    return {x: tuple(s[:4]) for x, s in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_corporate_actions_equal_a_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [tick(a, a, rnd.randrange(10**7, 10**10), a if rnd.random() > 0.1 else a - 300, instrument=rnd.randint(1, 9)) for a in range(1000, 1400)]
    acts = [(a, rnd.choice([100, 101, 102]), rnd.randint(1, 9), rnd.choice([actions.CHANGE, actions.ADDITION, actions.REMOVAL, "Split"]), rnd.randrange(1, 3 * 10**7)) for a in sorted(rnd.sample(range(1000, 1400), 25))]
    got = actions.values_after_actions(index_values.in_order(frame(spark, rows)), catalog.constituents(spark), spark.createDataFrame(acts, actions.ACTION_SCHEMA))
    assert {r.index_id: (r.value_e8, r.divisor, r.sequence, r.constituent_count) for r in got.collect()} == walk(rows, acts)


def test_removal_and_return(spark):
    rows = index_values.in_order(frame(spark, [tick(1, 1, 9_400_000_000, 1000)]))
    constituents = catalog.constituents(spark)
    gone = spark.createDataFrame([(2, 100, 1, actions.REMOVAL, 0)], actions.ACTION_SCHEMA)
    r = actions.values_after_actions(rows, constituents, gone).where("index_id = 100").first()
    assert (r.value_e8, r.divisor, r.level_e8, r.constituent_count) == (3_554_625_000, 3542429.874562219, 100_344_258_767, 7)
    back = gone.union(spark.createDataFrame([(3, 100, 1, actions.ADDITION, 18_000_000)], actions.ACTION_SCHEMA))
    r = actions.values_after_actions(rows, constituents, back).where("index_id = 100").first()
    assert (r.value_e8, r.divisor, r.level_e8, r.constituent_count) == (5_246_625_000, 5228625.0, 100_344_258_767, 8)


def test_receive_time_is_of_the_last_applied_tick(spark):
    got = latest_of(spark, [tick(1, 1, 9_400_000_000, 0, 1), tick(2, 1, 520_000_000, 1000, 5)])
    assert [got[x].timestamp_nanos for x in (100, 101, 102)] == [2000, 1000, 2000]


def test_results_of_rejected_ticks(spark):
    rows = [tick(1, 1, 9_400_000_000, 2000), tick(2, 2, 9_500_000_000, 1000, flags=17), tick(3, 3, 9_500_000_000, 500), tick(4, 1, 5, 1, 99)]
    got = index_values.tick_status(gates.report(frame(spark, rows)), catalog.constituents(spark))
    assert [r.result for r in got.orderBy("arrival").collect()] == ["applied", "stale", "failed", "failed"]


def test_routes():
    want = {2: [1, 0, 1, 0, 1, 0, 1, 0], 3: [1, 1, 2, 2, 2, 0, 0, 1], 4: [1, 2, 3, 0, 1, 2, 3, 0], 5: [1, 1, 2, 2, 2, 3, 3, 4], 6: [1, 4, 5, 2, 5, 0, 3, 4], 8: [1, 2, 3, 4, 5, 6, 7, 0]}
    assert {n: [synthetic.route(i, n) for i in range(1, 9)] for n in want} == want
    assert synthetic.route(123, 8) == 3


def test_route_columns(spark):
    ids = spark.range(1, 400).select(F.col("id").cast("int").alias("i"))
    got = ids.select("i", *[fixed.route(F.col("i"), n).alias(f"p{n}") for n in (1, 3, 8, 32)]).collect()
    assert all(r[f"p{n}"] == synthetic.route(r.i, n) for r in got for n in (1, 3, 8, 32))


def test_scaled_prices(spark):
    df = spark.sql("SELECT CAST(123.45678901 AS DECIMAL(28,10)) AS p UNION ALL SELECT CAST(-0.000000005 AS DECIMAL(28,10))")
    got = df.select(fixed.to_scaled(F.col("p")).alias("e"), fixed.from_scaled(fixed.to_scaled(F.col("p"))).alias("d")).collect()
    assert [r.e for r in got] == [12_345_678_901, -1] and str(got[0].d) == "123.45678901"


def test_frames(spark):
    rows = [(42, 3, 1, 123_456_789, 5, 7, 8, 2, 1), (-(2**63), -1, -(2**15), 2**63 - 1, -(2**31), 0, -5, 2**31 - 1, -128)]
    names = [n for n, _, _ in codec.TICK]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, _, k in codec.TICK))
    got = df.select(codec.encode(codec.TICK).alias("f"), *names).collect()
    import struct

    assert [bytes(r.f) for r in got] == [struct.pack("<qihqiqqib", *row) for row in rows]
    back = df.select(F.concat(codec.encode(codec.TICK), F.unhex(F.lit("FFFF"))).alias("f")).select(codec.decode(F.col("f"), codec.TICK).alias("t")).select("t.*")
    assert [tuple(r) for r in back.collect()] == rows
    assert spark.sql("SELECT unhex('00') AS f").select(codec.decode(F.col("f"), codec.TICK).alias("t")).first().t is None


def messages():
    import struct

    itch = struct.pack(">cHH", b"\x50", 1, 0) + (1_000_000_000).to_bytes(6, "big") + struct.pack(">QcI", 10_000, b"B", 1000) + b"AAPL    " + struct.pack(">IQ", 1_502_500, 1)
    entry = lambda kind, security, mantissa, exponent: struct.pack("<qbiiI", mantissa, exponent, 10, security, 1) + bytes(5) + kind + b"\0"
    cme = lambda *entries: struct.pack("<HHHHQB", 9, 50, 1, 1, 1_000_000_000, 0) + struct.pack("<HB", 28, len(entries)) + b"".join(entries)
    xdp = struct.pack("<HHIHIIIIII", 42, 220, 1_000_000_000, 0, 7, 1, 0, 0, 1000, 150_250) + bytes(8)
    pitch = struct.pack(">BB", 39, 0x2C) + (1_000_000_000).to_bytes(6, "big") + struct.pack(">QcI", 5, b"B", 1000) + b"AAPL  " + struct.pack(">Q", 1_502_500) + bytes(4)
    return {
        "itch": [itch, b"\x53" + itch[1:], itch[:1] + b"\x00\x63" + itch[3:], itch[:20]],
        "cme": [cme(entry(b"2", 12_345, 15_025, -2)), cme(entry(b"0", 12_345, 15_025, -2)), cme(entry(b"2", 9, 1, 0), entry(b"2", 12_345, 1_502_500_000_000, -10)), cme(entry(b"2", 12_345, 1, 3)), cme(), cme(entry(b"2", 12_345, 15_025, -2))[:30]],
        "xdp": [xdp, xdp[:2] + b"\xab\x00" + xdp[4:]],
        "pitch": [pitch, pitch[:1] + b"\x21" + pitch[2:], pitch.replace(b"AAPL", b"MSFT")],
    }


@pytest.mark.parametrize("protocol, exchange, quantity, sequence, ids", [("itch", 1, 1000, 10_000, [0]), ("cme", 2, 10, 1, [0, 2, 3]), ("xdp", 3, 1000, 1, [0]), ("pitch", 4, 1000, 0, [0])])
def test_messages(spark, protocol, exchange, quantity, sequence, ids):
    rows = [(i, m, 2_000_000_000) for i, m in enumerate(messages()[protocol])]
    symbols = spark.createDataFrame([("1", 1, 1), ("12345", 1, 1), ("7", 1, 1), ("AAPL", 1, 1)], "symbol_key string, instrument_id int, partition int")
    got = wire.parse(spark.createDataFrame(rows, "message_id bigint, message binary, receive_ts_nanos bigint"), protocol, symbols).orderBy("message_id").collect()
    assert [r.message_id for r in got] == ids
    assert all(r.price_e8 == 15_025_000_000 for r in got if r.message_id != 3) and all(r.price_e8 is None for r in got if r.message_id == 3)
    r = got[0]
    assert (r.exchange_id, r.quantity, r.sequence, r.exchange_ts_nanos, r.instrument_id) == (exchange, quantity, sequence, 1_000_000_000, 1)


def test_synthetic_feed(spark):
    want = [(3, 2, 1, 2383292956, 335, 3), (4, 1, 1, 2713579162, 3623, 0), (1, 1, 1, 527066142, 4641, 1), (7, 1, 1, 3317578659, 2347, 3), (7, 4, 2, 1742076697, 4544, 3), (5, 2, 1, 3557539716, 58, 1), (4, 4, 2, 1375819644, 133, 0), (6, 4, 1, 2093054664, 1305, 2)]
    spark.dataSource.register(synthetic.SyntheticTicks)
    got = spark.read.format("synthetic_ticks").option("rows", 8).load().orderBy("arrival").collect()
    assert [(r.instrument_id, r.exchange_id, r.sequence, r.price_e8, r.quantity, r.partition) for r in got] == want


def test_percentiles(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(5).alias("v"))
    r = metrics.percentiles(df, F.col("v"), F.col("id")).first()
    assert (r.samples, r.p50, r.p99) == (1000, 1, 5)
    assert metrics.percentiles(df.limit(0), F.col("v"), F.col("id")).first().p50 == 0


def test_reference_data(spark):
    good = (catalog.instruments(spark), catalog.indexes(spark), catalog.constituents(spark))
    rates = spark.createDataFrame([], "from_currency string, to_currency string, rate_e8 bigint")
    refdata.require_valid(1, 1, *good, rates)
    with pytest.raises(refdata.ReferenceDataError, match="must be positive"):
        refdata.require_valid(0, 1, *good, rates)
    dollars = good[0].withColumn("currency", F.when(F.col("instrument_id") == 5, "USD").otherwise("GBP"))
    messages_ = [r.message for r in refdata.validate(1, 1, dollars, *good[1:], rates).collect()]
    assert sorted(messages_) == ["Index 'IDX100' constituent 5 requires FX USD->GBP.", "Index 'IDX102' constituent 5 requires FX USD->GBP."]
    covered = spark.createDataFrame([("usd", "gbp", 78_000_000)], rates.schema)
    assert refdata.validate(1, 1, dollars, *good[1:], covered).isEmpty()


def test_tables_break_every_rule(spark):
    rules = market.QUERIES["refdata_errors"](spark, "/root/testdata/sf0.01").select("rule").distinct().collect()
    assert {r.rule for r in rules} == {f"V{i}" for i in range(1, 28)}


def test_weights_equal_a_fold(spark):
    """Many actions on one slot, over many blocks, ties among them."""
    rnd = random.Random(6)
    held = [(1, 1, 5), (1, 2, 0), (2, 1, 7)]
    rows = [(rnd.randrange(0, 400_000, 3), *rnd.choice(held)[:2], rnd.choice([actions.CHANGE, actions.ADDITION, actions.ADDITION, actions.REMOVAL, "Split"]), rnd.choice([0, 3, 4])) for _ in range(600)]
    constituents = spark.createDataFrame(held, "index_id smallint, instrument_id int, weight_e8 bigint")
    got = actions.weight_history(spark.createDataFrame(rows, actions.ACTION_SCHEMA), constituents).collect()
    want, weights = [], {h[:2]: h[2] for h in held}
    for o, x, i, kind, w in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        if kind == "Split" or kind == actions.ADDITION and weights[x, i] != 0:
            continue
        after = 0 if kind == actions.REMOVAL else w
        want.append((x, i, o, kind, weights[x, i], after))
        weights[x, i] = after
    assert sorted(map(tuple, got)) == sorted(want)


def test_upsert_guards_the_sequence(spark):
    schema = "index_id int, sequence bigint, value_e8 bigint"
    stored = spark.createDataFrame([(1, 5, 50), (2, 5, 50)], schema)
    news = spark.createDataFrame([(1, 9, 90, 1), (1, 4, 40, 2), (2, 6, 60, 1), (3, 1, 10, 1)], schema + ", arrival bigint")
    assert sorted(tuple(r) for r in latest.upsert(stored, news).collect()) == [(1, 5, 50), (2, 6, 60), (3, 1, 10)]


def test_reference_data_sorts_no_constituents_and_its_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(reference, "ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    tables = [make(spark, SF) for make in (reference.instruments, reference.indexes, reference.constituents, reference.fx_rates)]
    plan = refdata.validate(1, 1, *tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert f"{lines // 500})" in {p.split(", ")[1].split(", ")[0] for p in re.findall(r"hashpartitioning\(index_id#\d+L, \d+\)", plan)}  # the session has 4 partitions
