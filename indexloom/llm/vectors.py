"""Columns of vectors: which rows can be computed with, and their entries as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, below: float = float("inf")) -> Column:
    """Whether a vector is there and has no null, no NaN, and nothing whose absolute value is not below ``below``."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < below) & ~F.isnan(x), F.lit(False))), F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The number of entries that most vectors have (the largest such number); 0 for no vectors. One row a length is compared."""
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return max(most or 0, 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The entries of vectors of ``dims`` entries as doubles, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims).astype(np.float64)


def pack(values: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes that holds all of them, little-endian, row by row."""
    most = int(np.abs(values).max(initial=0))
    return np.ascontiguousarray(values, "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    """What ``pack`` has packed, as 64-bit integers."""
    if not rows * columns:
        return np.zeros((rows, columns), np.int64)
    return np.frombuffer(data, f"<i{len(data) // (rows * columns)}").reshape(rows, columns).astype(np.int64)
