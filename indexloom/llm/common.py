"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import checkpoint_dir, cut  # noqa: F401  for the operators

#: A word is a maximal run of code points other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step works on at most, unless a single text is longer.
STEP_BYTES = 1_000_000


#: A key with over one in OFTEN of all rows is frequent; there are fewer than OFTEN such keys, however many rows there are.
OFTEN = 1000

#: Narrow rows (keys, edges) that one task reads; fewer rows are not spread over more tasks than there are cores.
NARROW = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _trim() -> object:
    """glibc's malloc_trim; None where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, which allocators else keep for as long as a worker is reused."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def slices(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, list]]:
    """(start, stop, values) of runs of rows of about ``size`` bytes; each row is in one run, and only one run's values are held as Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, base + size)), start) + 1, len(column))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop
    give_back()


def split_words(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts as UTF-8, in order, and the number of words in each text (null: none)."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes.split() cuts at exactly WORD's gaps
        words += found
        counts.append(len(found))
    return words, np.asarray(counts, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def record_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, or a longer name where a column (in any case) has it already."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, n: int) -> DataFrame:
    """``df``, whose last step reads about ``n`` narrow rows, in no more tasks than they need: the driver keeps a record of every task."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // NARROW)))


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key and in ``n`` how many of ``rows`` have it.

    The fewer than OFTEN frequent keys reach their rows by broadcast, so that no task gets all rows of one of them; all
    other keys are shuffled. ``rows`` is read twice and ``keyed`` three times, so each should be written already, or be no
    more than a grouping by ``key`` of what is written: Spark then shuffles it once. Nothing runs here if ``size`` is given, as
    each query that runs costs the driver memory. Tasks and what is frequent follow ``size``, which is how many rows ``rows``
    has (at least the sum of ``n``), few of which may have a key of ``keyed``; they are counted unless it is given.
    """
    size = rows.count() if size is None else size
    keyed, most = gathered(keyed, size), size / OFTEN
    often, rest = F.broadcast(keyed.where(F.col("n") > most)), keyed.where(F.col("n") <= most)
    return gathered(rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(rest, key)), size)
