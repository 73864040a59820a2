"""Fixed-width little-endian frames of ticks (47 bytes) and index values (42 bytes), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of the frames, their widths in bytes and their types.
TICK = [
    ("sequence", 8, "bigint"),
    ("instrument_id", 4, "int"),
    ("exchange_id", 2, "smallint"),
    ("price_e8", 8, "bigint"),
    ("quantity", 4, "int"),
    ("exchange_ts_nanos", 8, "bigint"),
    ("receive_ts_nanos", 8, "bigint"),
    ("partition", 4, "int"),
    ("flags", 1, "tinyint"),
]
INDEX_VALUE = [
    ("index_id", 2, "smallint"),
    ("sequence", 8, "bigint"),
    ("value_e8", 8, "bigint"),
    ("level_e8", 8, "bigint"),
    ("timestamp_nanos", 8, "bigint"),
    ("constituent_count", 4, "int"),
    ("stale_constituent_count", 4, "int"),
]

Layout = list[tuple[str, int, str]]


def width(layout: Layout) -> int:
    return sum(n for _, n, _ in layout)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(frame: Column, offset: int | Column, size: int, big: bool) -> Column:
    """The hexadecimal digits of an integer at an offset (from 0), highest first."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    if big:
        return F.hex(F.substring(frame, at, F.lit(size)))
    return F.concat(*[F.hex(F.substring(frame, at + i, F.lit(1))) for i in reversed(range(size))])


def unsigned(frame: Column, offset: int | Column, size: int, big: bool = False) -> Column:
    """An unsigned integer of up to eight bytes at an offset (from 0); eight bytes wrap into a signed bigint."""
    return F.conv(_digits(frame, offset, size, big), 16, -10).cast("bigint")


def signed(frame: Column, offset: int | Column, size: int, big: bool = False) -> Column:
    raw = unsigned(frame, offset, size, big)
    return raw if size == 8 else (raw + (1 << 8 * size - 1)).bitwiseAND((1 << 8 * size) - 1) - (1 << 8 * size - 1)


def integer(value: Column, size: int) -> Column:
    """The little-endian bytes of an integer."""
    digits = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def encode(layout: Layout) -> Column:
    """The frame of columns with the names of the layout."""
    return F.concat(*[integer(F.col(name), n) for name, n, _ in layout])


def decode(frame: Column, layout: Layout) -> Column:
    """A struct of the fields; null for a null or short frame. Bytes after the frame are passed over."""

    def fields(f: Column) -> Column:
        out, at = [], 0
        for name, n, kind in layout:
            out.append(signed(f, at, n).cast(kind).alias(name))
            at += n
        return F.when(F.octet_length(f) >= at, F.struct(*out))

    return let(frame, fields)
