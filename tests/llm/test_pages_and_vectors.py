"""Archives, hard negatives and whitening against brute force, and their defined results for odd rows."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from indexloom.llm import negatives, shared, vectors, warc, whitening

PAGES = "page_id long, url string, html string, digest string, payload string, first string"
ROWS = "vec_id long, embedding array<float>, label int, x string, row string, n string, distances string"


def base32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


# 11

ODD_PAGES = [(1, "http://a/", "one"), (2, None, "one"), (3, "http://ü/\r\nX-Bad: 1", None), (9, "u", ""), (None, "u", "one"), (None, None, None), (7, "u", "only"), (None, "u", "no id"), (5, "x", "same"), (5, "x", "same"), (4, "x", "same"), (8, "u", "long wörds " * 300_000), (10, "u", "\x1f\x8b\x08 not gzip")]


def expected(pages):
    greatest = {}
    for i, _, html in pages:
        d = base32(html)
        greatest[d] = max((x for x in (greatest.get(d), i) if x is not None), default=None)
    out = []
    for i, _, html in pages:
        d = base32(html)
        first = greatest[d]
        out.append((i, len((html or "").encode()), d, "response" if i == first else "revisit", None if i == first else first))
    return Counter(out)


def test_pages_by_brute_force(spark, tmp_path):
    rows = [(*p, "extra", "extra", "extra") for p in ODD_PAGES]
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op11_warc(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in got.collect()) == expected(ODD_PAGES)


def test_archives_are_plain_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}?a=b&c", "p" * (i % 5)) for i in range(40)], "page_id long, url string, html string")
    files = warc.write_warc(warc.with_references(pages).coalesce(1), str(tmp_path / "out"), limit=4000).collect()
    assert len(files) > 1 and sum(f.n for f in files) == 40
    data = b"".join(gzip.open(f.path).read() for f in files)
    heads = data.split(b"WARC/1.1\r\n")[1:]
    assert len(heads) == 40 and sum(b"WARC-Type: revisit" in h for h in heads) == 35
    for h in heads:
        head, _, block = h.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
        assert block.endswith(b"\r\n\r\n") and len(block) == int(fields[b"Content-Length"]) + 4 and fields[b"WARC-Target-URI"].startswith(b"http://h/")


@pytest.mark.parametrize("split", [600, 4000, 1 << 20])
def test_every_split_owns_each_record_once(spark, tmp_path, split):
    """Payloads that hold whole archives, in stored blocks, give no records of their own wherever ranges are cut."""
    rnd = random.Random(split)
    inner = b"".join(warc.record(i, "u", rnd.randbytes(50), base32("x"), None) for i in range(3))
    noise = lambda n: rnd.randbytes(n)
    payloads = [b"", b"abc" * 500, noise(3000), inner, noise(700) + inner + noise(700), inner * 3, noise(40_000)]
    members = [warc.record(i, "u", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None) for i, p in enumerate(payloads)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long")
    ends = np.cumsum([len(m) for m in members]).tolist()
    got = sorted((r.offset, r.end, r.payload_bytes, r.payload_digest) for r in warc.index_warc(files, split).collect())
    assert got == [(e - len(m), e, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for e, m, p in zip(ends, members, payloads, strict=True)]
    read = warc.read_warc(files, split).collect()
    assert sorted((r.offset, bytes(r.payload)) for r in read) == [(e - len(m), p) for e, m, p in zip(ends, members, payloads, strict=True)]


def test_ranges_of_any_size_find_the_same_records(tmp_path):
    rnd = random.Random(9)
    members = [warc.record(i, "u", rnd.randbytes(rnd.randint(0, 400)), base32("x"), None) for i in range(12)]
    path = tmp_path / "r.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    want = np.cumsum([0, *map(len, members)])[:-1].tolist()
    with path.open("rb") as f:
        for split in (1, 2, 3, 50, 777, size):
            assert [r.offset for a in range(0, size, split) for r in warc.records_in(warc.Source(f), a, min(a + split, size))] == want


def test_damaged_records_are_passed_over(tmp_path):
    good = [warc.record(i, "u", b"payload %d" % i, base32("x"), None) for i in range(3)]
    cut_off, no_warc = good[1][:-9], gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    path = tmp_path / "d.warc.gz"
    path.write_bytes(b"junk" + good[0] + cut_off + no_warc + short + b"\x1f\x8b\x08" + good[2] + b"\x1f\x8b")
    with path.open("rb") as f:
        assert [r.fields["x-page-id"] for r in warc.records_in(warc.Source(f), 0, path.stat().st_size)] == ["0", "2"]


def test_addresses_of_stores():
    for address in ("/tmp/a b", "file:/tmp/a b", "file:///tmp/a b"):
        assert shared.store(address)[1] == "/tmp/a b"


# 12


def brute_negatives(rows):
    """Rows as the contract words them, every anchor against every row."""
    usual = Counter(len(v) for _, v, label, *_ in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v))
    dims = max(usual, key=lambda n: (usual[n], n), default=0)
    own = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v) or len(v) != dims:
            continue
        own.append((i, [math.floor(256 * float(np.float32(c))) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: math.inf if i is None else i
    out = []
    for anchor in {(i, tuple(v), label) for i, v, label in own if i is not None and i % 100 == 0}:
        scored = sorted(((sum(map(int.__mul__, anchor[1], v)), i, label) for i, v, label in own), key=lambda s: (-s[0], last(s[1])))
        for ps, pid, _ in [s for s in scored if s[2] == anchor[2] and s[1] != anchor[0]][:5]:
            found = [s for s in scored if s[2] != anchor[2] and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(anchor[0], pid, n + 1, s[1], ps, s[0]) for n, s in enumerate(found)]
    return Counter(out)


def vector_rows(seed, n=700, dims=12, labels=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, dims))
    x = centres[rnd.integers(0, 8, n)] * rnd.choice([0.2, 1.0], (n, 1)) + rnd.normal(size=(n, dims)) * 0.3
    if seed == 2:
        x = np.round(x)  # many ties and copies
    return [(i, [float(v) for v in x[i]], int(rnd.integers(0, labels)) if rnd.random() < 0.7 else 1) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["extra"] * 4) for r in rows], ROWS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_negatives_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BITS", 5)
    rows = vector_rows(seed)
    if seed == 3:
        rows = [(i * 50, v, label) for i, v, label in rows]  # many anchors
        nan, inf = float("nan"), float("inf")
        rows += [(None, rows[0][1], 1), (None, rows[1][1], 2), rows[3], rows[4], (100, rows[2][1], 3), (11, None, 1), (12, [nan] * 12, 1), (13, [inf] * 12, 1), (14, [None] * 12, 1), (15, rows[0][1], None), (16, [1.0] * 3, 1), (17, [], 1), (200, [1.0] * 11 + [float("nan")], 1)]
    got = negatives.hard_negatives(frame(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_brackets_hold_and_narrow():
    rnd = np.random.default_rng(5)
    x = np.vstack([np.floor(rnd.normal(c, 8, (300, 6))) for c in (-90, 0, 120)]).astype(np.int64)
    most = int((x * x).sum(1).max()) + 1
    points = negatives.spread_pivots(negatives.augmented(x, most))
    block = {"x": x, "distances": negatives.distances(negatives.augmented(x, most), points)}
    excluded = 0
    for q in x[::50]:
        low, high = negatives.bracket(block, negatives.distances(np.append(q.astype(float), 0.0)[None], points)[0], float(q @ q), most)
        score = negatives.scores(block, np.arange(len(x)), q)
        assert (low <= score).all() and (score <= high).all()
        excluded += (high < np.sort(score)[-50]).sum()
    assert excluded > len(x) * len(x[::50]) / 3


def test_large_entries_are_exact(spark):
    rows = [(100, [4e6, 1.0], 1), (1, [4e6, 3.0], 1), (2, [3e6, 1.0], 2), (3, [3e6, 1.25], 2)]
    got = negatives.hard_negatives(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows) and len(got) == 2


def test_packed_integers():
    for most in (0, 5, 1 << 15, 1 << 40):
        x = np.array([[most, -most, 1], [2, 3, most]], np.int64)
        assert (vectors.unpack(vectors.pack(x), 2, 3) == x).all()
    assert vectors.unpack(b"", 4, 0).shape == (4, 0)


# 13


def whitened_rows(spark, rows):
    got = whitening.whiten(frame(spark, rows)).collect()
    return {r.vec_id: r for r in got}, got


@pytest.mark.parametrize(("n", "dims"), [(500, 12), (300, 70), (900, 300)])
def test_whitening_by_brute_force(spark, n, dims, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rnd = np.random.default_rng(n)
    x = (rnd.normal(size=(n, dims)) * rnd.uniform(0.1, 3, dims) + rnd.normal(size=dims)).astype(np.float32)
    by_id, rows = whitened_rows(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])
    y = np.floor(x.astype(float) * 1024).astype(np.int64) + 100_000
    sums = y.sum(0)
    centred = y - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = centred @ u / np.sqrt(e)
    got = np.array([by_id[i].whitened for i in range(n)])
    want *= np.sign((want * got).sum(0))
    assert np.allclose(got, want, atol=1e-7) and len(rows) == n
    assert np.allclose(rows[0].explained, e / np.trace(centred.T @ centred / n), rtol=1e-9)
    assert all(by_id[i].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(y[i], sums, strict=True)) for i in range(n))
    assert rows[0].n == n and rows[0].identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0], 0), (2, [2.0, -1.0], None), (2, [2.0, -1.0], None), (None, [0.5, 0.0], 1)]
    odd = [(5, None, 0), (6, [nan, 0.0], 0), (7, [inf, 0.0], 0), (8, [None, 1.0], 0), (9, [1.0], 0), (10, [], 0), (11, [1e30, 0.0], 0)]
    got = whitening.whiten(frame(spark, good + odd)).collect()
    assert sorted(repr(r.vec_id) for r in got) == ["1", "2", "2", "None"] and {r.n for r in got} == {4}
    assert all(len(r.whitened) == 2 for r in got) and got[0].identity_error < 1e-9
    flat = whitening.whiten(frame(spark, [(1, [1.0, 5.0], 0), (2, [2.0, 5.0], 0)])).collect()  # the second dimension does not vary
    assert all(r.whitened[1] is None and abs(abs(r.whitened[0]) - 1) < 1e-12 for r in flat) and flat[0].identity_error < 1e-9
    alone = whitening.whiten(frame(spark, [(1, [1.0, 5.0], 0)])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(0, [None] * 2, [None] * 2, None)]
    assert whitening.whiten(frame(spark, odd[:4])).count() == 0


def test_deviations_beyond_a_long():
    y = np.array([[3, -4], [1 << 40, 0], [-(1 << 31), 1]], np.int64)
    rest = np.array([5, 7], np.int64)
    for n in (3, 10**10):
        exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
        assert whitening.deviations(y, rest, n) == [x if x < 1 << 63 else None for x in exact]
        assert whitening.deviations(y[:1], rest, n) == [x if x < 1 << 63 else None for x in exact[:1]]
