"""Fixed-point numbers with eight decimals, tick flags and partition routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000
BASE_LEVEL = 1000.0

# Bits of a tick's flags.
NONE, TRADE, BID, ASK, SYNTHETIC, STALE, CORRECTED = 0, 1, 2, 4, 8, 16, 32

#: Multiplier of the routing hash, and its word size.
ROUTE_MULTIPLIER = 2_654_435_761
WORD = (1 << 32) - 1


def div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b)


def to_scaled(price: Column) -> Column:
    """A price as an integer of 1e-8 units, halves away from zero."""
    return F.round(price.cast("decimal(28,10)") * SCALE, 0).cast("bigint")


def from_scaled(price_e8: Column) -> Column:
    return (price_e8.cast("decimal(20,0)") / F.lit(SCALE).cast("decimal(9,0)")).cast("decimal(28,8)")


def contribution(price_e8: Column, weight_e8: Column) -> Column:
    """price * weight / 1e8, truncated; the product is worked out in 38 digits, so it cannot wrap."""
    product = price_e8.cast("decimal(19,0)") * weight_e8.cast("decimal(19,0)")
    return div(product, F.lit(SCALE).cast("decimal(9,0)"))


def level(value_e8: Column, divisor: Column) -> Column:
    """The index level; 0 where the divisor is 0, as after all constituents have gone."""
    return F.when(divisor == 0, F.lit(0)).otherwise(F.try_divide(value_e8.cast("double"), divisor) * float(SCALE)).cast("bigint")


def is_stale(flags: Column) -> Column:
    return flags.bitwiseAND(STALE) != 0


def route(instrument_id: Column, partitions: int) -> Column:
    """The partition of an instrument: a multiplicative hash of 32 bits, masked or reduced."""
    if partitions <= 1:
        return F.lit(0)
    h = (instrument_id.cast("bigint").bitwiseAND(WORD) * F.lit(ROUTE_MULTIPLIER)).bitwiseAND(WORD)
    power_of_two = partitions & (partitions - 1) == 0
    return (h.bitwiseAND(partitions - 1) if power_of_two else h % partitions).cast("int")
