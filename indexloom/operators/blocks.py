"""Running values in two steps, so that a key with very many rows does not end in one task.

Rows are ordered by (o1, o2). The range of o1 is cut into blocks; windows run within a key's block, and a second, short
window runs over one summary row for each key and block. Only the summaries are written; the rows are read again for the
windows, so each running value costs one more pass over the columns that it needs, and no plan holds its input twice. Where
running values of one key are stacked, the column BLOCK_COLUMN stays with the rows, and all windows share one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

#: Values of o1 that a block spans.
BLOCK = 1 << 16

#: Blocks that one window over summaries spans; beyond that the summaries are blocked in turn.
WIDE = 1 << 12

#: The block of a row, as long as its key and order stay.
BLOCK_COLUMN = "__block"

MAX, LAST, SUM = "max", "last", "sum"


def _summary(kind: str, c: Column) -> Column:
    if kind == LAST:
        return F.max_by(c, F.when(c.isNotNull(), F.struct("o1", "o2")))
    return F.max(c) if kind == MAX else F.sum(c)


def _over(kind: str, c: Column, window) -> Column:
    return (F.last(c, ignorenulls=True) if kind == LAST else F.max(c) if kind == MAX else F.sum(c)).over(window)


def _both(kind: str, own: Column, carried: Column) -> Column:
    if kind == LAST:
        return F.coalesce(own, carried)
    return F.greatest(own, carried) if kind == MAX else F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))


def in_blocks(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``df`` with the block of each row, for running values that are to share one layout."""
    return df.withColumn(BLOCK_COLUMN, F.call_function("div", F.col("o1"), F.lit(block)))


def running(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, Column]], before: bool = True, block: int = BLOCK) -> DataFrame:
    """``df`` with, for each name in ``wanted``, the maximum, last value that is not null, or sum of a column over the rows of
    the key before a row (with ``before``), or up to it. Names start out null, sums at 0. Runs one job, whose result has a row a key and block."""
    keys = [*by, BLOCK_COLUMN]
    blocked = df if BLOCK_COLUMN in df.columns else in_blocks(df, block)
    blocked = blocked.select("*", *[c.alias(f"__{n}") for n, (_, c) in wanted.items()])
    carried = _carried(blocked.groupBy(*keys).agg(*[_summary(k, F.col(f"__{n}")).alias(f"__{n}") for n, (k, _) in wanted.items()]), by, {n: k for n, (k, _) in wanted.items()})
    within = Window.partitionBy(*keys).orderBy("o1", "o2").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = blocked.select("*", *[_over(k, F.col(f"__{n}"), within).alias(f"__{n}_own") for n, (k, _) in wanted.items()])
    return own.join(carried, keys).select(*[F.col(c) for c in df.columns], *[_both(k, F.col(f"__{n}_own"), F.col(f"__{n}_carried")).alias(n) for n, (k, _) in wanted.items()])


def _carried(summaries: DataFrame, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """What each block starts from. Where a key has many blocks, blocks of blocks are summed up first."""
    summaries = cut(summaries)
    low, high = summaries.agg(F.min(BLOCK_COLUMN), F.max(BLOCK_COLUMN)).first()
    earlier = Window.partitionBy(*by).orderBy(BLOCK_COLUMN).rowsBetween(Window.unboundedPreceding, -1)
    if low is None or high - low <= WIDE:
        return summaries.select(*by, BLOCK_COLUMN, *[_over(k, F.col(f"__{n}"), earlier).alias(f"__{n}_carried") for n, k in kinds.items()])
    above = summaries.select(*by, F.col(BLOCK_COLUMN).alias("o1"), F.lit(0).alias("o2"), *[f"__{n}" for n in kinds])
    over = running(above, by, {f"__{n}_carried": (k, F.col(f"__{n}")) for n, k in kinds.items()}, block=WIDE)
    return over.select(*by, F.col("o1").alias(BLOCK_COLUMN), *[f"__{n}_carried" for n in kinds])
