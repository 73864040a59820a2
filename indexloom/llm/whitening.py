"""Operator 13, whitening of embeddings: a covariance in tiles, and projections on its first components.

Entries become integers, floor(1024 * c). (The contract adds 100,000 to each; that shift leaves every centred value as it
is, so it is not carried along.) One pass counts rows and sums each dimension exactly. For the covariance V, dimensions
are cut into at most TILES column blocks, rows into row blocks of ROWS; each column block of a row block goes to all tiles
(pairs of column blocks) that it is half of, meets the other half there by an equal join on the row block and the column
block, and is centred and multiplied; products are summed by tile, first in each task, then in SPREAD parts, then whole. The
tiles are assembled on the driver (as many doubles as dimensions squared, however many rows there are), whose
eigenvectors, in the order of falling eigenvalues, give the projections. The rows are whitened in a last pass, which is
written once: the covariance of what was written is what ``identity_error`` tells.

Defined results: rows whose vector is null, has a null, NaN or infinite entry, one of 2**52 or more, or another number of
entries than most vectors have (the larger number on a tie) take no part, neither in the fit nor in the result; a null
vec_id is kept; rows that repeat count each time; of fewer dimensions than COMPONENTS all are returned; a component
without variance (up to 1e-12 of the trace) has whitened null and is left out of identity_error, which is null if no
component has any; explained is null where the trace is 0; a deviation beyond the range of long is null; further columns
are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, record_batch, table
from .vectors import finite, matrix, pack, unpack, usual_length

SCALE = 1024
COMPONENTS = 8

#: Rows of a row block, dimensions of a column block at least, and column blocks at most.
ROWS, LEAST, TILES = 2048, 32, 8

#: Parts in which a tile's products are summed before they meet.
SPREAD = 16

#: Entries below it are scaled to integers that a long holds.
BELOW = float(1 << 52)


def scaled(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part, and the number of their dimensions."""
    valid = rows.where(finite(F.col(vector), BELOW))
    dims = usual_length(valid, vector)
    return valid.where(F.size(vector) == dims), dims


def integers(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(matrix(column, dims) * SCALE).astype(np.int64)


def sums(rows: DataFrame, vector: str, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = integers(batch.column(0), dims)
            n += len(x)
            high += (x >> 32).sum(0)  # in halves, so that no sum of up to 2**31 rows wraps
            low += (x & 0xFFFFFFFF).sum(0)
        total = [Decimal((int(h) << 32) + int(w)) for h, w in zip(high, low, strict=True)]
        yield record_batch({"dim": (range(dims), pa.int32()), "n": ([n] * dims, pa.int64()), "total": (total, pa.decimal128(38, 0))})

    by_dim = rows.select(vector).mapInArrow(run, "dim int, n bigint, total decimal(38,0)").groupBy("dim").agg(F.sum("n"), F.sum("total")).collect()  # one row a dimension
    by_dim.sort()
    return (by_dim[0][1] if by_dim else 0), [int(t) for _, _, t in by_dim]


def column_blocks(rows: DataFrame, vector: str, dims: int, edges: list[int]) -> DataFrame:
    """(row_block, block, n, data): integers of up to ROWS rows, cut at the edges of column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = integers(batch.column(0).slice(start, ROWS), dims)
                parts = [pack(x[:, a:z]) for a, z in zip(edges, edges[1:], strict=False)]
                yield record_batch({"row_block": ([number] * len(parts), pa.int64()), "block": (range(len(parts)), pa.int32()), "n": ([len(x)] * len(parts), pa.int32()), "data": (parts, pa.binary())})
                number += 1

    return rows.select(vector).mapInArrow(run, "row_block bigint, block int, n int, data binary")


def _totals(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return record_batch({"i": ([i for i, _ in held], pa.int32()), "j": ([j for _, j in held], pa.int32()), "data": ([x.tobytes() for x in held.values()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each tile of a task; a task holds one sum for each of few tiles."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(data)
            held[i, j] = held[i, j] + x if (i, j) in held else x
    yield _totals(held)


def covariance(rows: DataFrame, vector: str, dims: int, n: int, totals: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the scaled vectors."""
    width = max(LEAST, -(-dims // TILES))
    edges = [*range(0, dims, width), dims]
    whole = np.array([t // n for t in totals], np.int64)
    rest = np.array([t % n / n for t in totals])

    def centred(data: bytes, m: int, block: int) -> np.ndarray:
        a, z = edges[block], edges[block + 1]
        return (unpack(data, m, z - a) - whole[a:z]) - rest[a:z]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):  # one pair of matrices at a time
                i, j, m, left, right = (c[row].as_py() for c in batch.columns)
                product = centred(left, m, i).T @ centred(right, m, j)
                held[i, j] = held[i, j] + product if (i, j) in held else product
        yield _totals(held)

    blocks = column_blocks(rows, vector, dims, edges)
    left = blocks.select("row_block", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(len(edges) - 2))).alias("j"), "n", F.col("data").alias("left"))
    right = blocks.select("row_block", F.col("block").alias("j"), F.col("data").alias("right"))
    pairs = left.join(right, ["row_block", "j"]).select("i", "j", "n", "left", "right")
    schema = "i int, j int, data binary"
    products = pairs.mapInArrow(multiply, schema)
    parts = products.withColumn("part", F.spark_partition_id() % SPREAD).repartition("i", "j", "part").drop("part").mapInArrow(_added, schema)
    tiles = parts.repartition("i", "j").mapInArrow(_added, schema).collect()  # at most TILES * (TILES + 1) / 2 tiles
    out = np.zeros((dims, dims))
    for t in tiles:
        (a, z), (b, y) = edges[t.i : t.i + 2], edges[t.j : t.j + 2]
        out[a:z, b:y] = np.frombuffer(t.data).reshape(z - a, y - b)
        out[b:y, a:z] = out[a:z, b:y].T
    return out / n


def principal(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues, falling, and their unit vectors as columns; the largest entry of each is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


def deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """The sum over dimensions of (n * y - rest)**2 of each row, exact; null where a long does not hold it."""
    d = y.shape[1]
    small = int(np.abs(y).max(initial=0)) < 1 << 31 and max(int(np.abs(y).max(initial=0)), int(rest.max(initial=0))) ** 2 * d < 1 << 62
    if small:
        squares, mixed = (y * y).sum(1).tolist(), (y @ rest).tolist()
    else:
        squares, mixed = zip(*((sum(v * v for v in r), sum(v * w for v, w in zip(r, rest.tolist(), strict=True))) for r in y.tolist()), strict=True) if len(y) else ((), ())
    last = sum(v * v for v in rest.tolist())
    exact = [n * n * s - 2 * n * m + last for s, m in zip(squares, mixed, strict=True)]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error): each row's first components as arrays."""
    schema = f"{key} bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>"
    valid, dims = scaled(rows.select(F.col(key).cast("bigint").alias(key), vector), vector)
    n, totals = sums(valid, vector, dims) if dims else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    v = covariance(valid, vector, dims, n, totals)
    e, u = principal(v, count)
    trace = float(np.trace(v))
    real = e > 1e-12 * trace
    explained = (e / trace).tolist() if trace > 0 else [None] * len(e)
    axes = u / np.sqrt(np.where(real, e, 1.0))
    whole = np.array([t // n for t in totals], np.int64)
    rest = np.array([t % n for t in totals], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                own = batch.slice(start, ROWS)
                y = integers(own.column(1), dims) - whole
                w = (y - rest / n) @ axes
                values = pa.array(w.ravel(), mask=np.tile(~real, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * len(e), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([n] * len(w), pa.int64()), pa.array(deviations(y, rest, n), pa.int64()), lists, pa.array([explained] * len(w), pa.list_(pa.float64()))], names=[key, "n", "deviation", "whitened", "explained"])

    out = cut(valid.select(key, vector).mapInArrow(run, schema))
    used = [c for c in range(len(e)) if real[c]]
    at = [F.element_at("whitened", c + 1) for c in used]
    means = [F.avg(x).alias(f"m{c}") for c, x in zip(used, at, strict=True)]
    products = [F.avg(at[a] * at[b]).alias(f"p{a}_{b}") for a in range(len(used)) for b in range(a, len(used))]
    got = out.agg(*means, *products).first() if used else None
    errors = [abs(got[f"p{a}_{b}"] - got[f"m{used[a]}"] * got[f"m{used[b]}"] - (a == b)) for a in range(len(used)) for b in range(a, len(used))]
    return out.withColumn("identity_error", F.lit(max(errors) if errors else None).cast("double"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
