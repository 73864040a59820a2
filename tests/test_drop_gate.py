"""The drop gate by composed blocks equals a fold over each instrument."""

import random

import pytest

from indexloom.operators import gates


def streams(seed):
    rnd = random.Random(seed)
    rows, arrival = [], 0
    for instrument in range(1, 6):
        order = list(range(rnd.choice([1, 5]), rnd.randint(20, 120)))
        order = [s for s in order if rnd.random() > (0.0 if instrument < 3 else 0.01)]  # a hole that nothing fills ends the chain
        for _ in range(rnd.choice([0, 15])):
            i = rnd.randrange(len(order))
            order.insert(rnd.randrange(len(order)), order[i])  # copies, early and late
        for s in order:
            arrival += rnd.randint(1, 3)
            rows.append((arrival, s, instrument, "extra"))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_blocks_equal_a_fold(spark, seed, block):
    rows = streams(seed)
    want = []
    for instrument in {r[2] for r in rows}:
        gate = gates.Gate(gates.DROP)
        for i, (arrival, sequence, *_) in enumerate(sorted(r for r in rows if r[2] == instrument)):
            want += [(arrival, sequence, instrument, "extra", r.status) for r in gate.accept(i, sequence, arrival)]
    got = gates.drop(spark.createDataFrame(rows, "arrival bigint, sequence bigint, instrument_id int, other string"), block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_ticks(spark):
    assert gates.drop(spark.createDataFrame([], "arrival bigint, sequence bigint, instrument_id int")).count() == 0
