"""Trade messages of four exchange protocols, as column expressions.

Each parser gives a struct of what the message says, with the key of its symbol, or null for a message that is short, of
another kind, or (where noted) not a trade. ``map_symbols`` joins the keys to instruments; unmapped messages have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .codec import let, signed, unsigned

# Kinds of messages, least lengths, exchanges and price factors.
ITCH_TRADE, ITCH_LENGTH, ITCH_EXCHANGE, ITCH_FACTOR = 0x50, 44, 1, 10_000
XDP_TRADE, XDP_LENGTH, XDP_EXCHANGE, XDP_FACTOR = 220, 42, 3, 100_000
PITCH_TRADE, PITCH_LENGTH, PITCH_EXCHANGE, PITCH_FACTOR = 0x2C, 39, 4, 10_000
CME_TEMPLATE, CME_LENGTH, CME_EXCHANGE, CME_TRADE, CME_HEADER = 50, 20, 2, 0x32, 8
CME_ENTRY_TYPE_AT = 26


def _trade(exchange: int, key: Column, sequence: Column, price_e8: Column, quantity: Column, exchange_ts: Column) -> Column:
    wrapped = F.when(quantity >= 1 << 31, quantity - (1 << 32)).otherwise(quantity)
    return F.struct(key.cast("string").alias("symbol_key"), sequence.alias("sequence"), F.lit(exchange).cast("smallint").alias("exchange_id"), price_e8.cast("bigint").alias("price_e8"), wrapped.cast("int").alias("quantity"), exchange_ts.alias("exchange_ts_nanos"))


def itch(m: Column) -> Column:
    """Big-endian trades; the sequence is an order reference, times count from midnight."""
    trade = _trade(ITCH_EXCHANGE, unsigned(m, 1, 2, True), unsigned(m, 11, 8, True), unsigned(m, 32, 4, True) * ITCH_FACTOR, unsigned(m, 20, 4, True), unsigned(m, 5, 6, True))
    return F.when((F.octet_length(m) >= ITCH_LENGTH) & (unsigned(m, 0, 1) == ITCH_TRADE), trade)


def xdp(m: Column) -> Column:
    """Little-endian trades; times count within a second."""
    trade = _trade(XDP_EXCHANGE, unsigned(m, 10, 4), unsigned(m, 14, 4), unsigned(m, 30, 4) * XDP_FACTOR, unsigned(m, 26, 4), unsigned(m, 4, 4))
    return F.when((F.octet_length(m) >= XDP_LENGTH) & (unsigned(m, 2, 2) == XDP_TRADE), trade)


def pitch(m: Column) -> Column:
    """Big-endian trades with a symbol of six characters, padded on the right; there is no sequence, so it is 0."""
    price = unsigned(m, 27, 8, True).cast("decimal(20,0)") * PITCH_FACTOR
    trade = _trade(PITCH_EXCHANGE, F.rtrim(F.decode(F.substring(m, 22, 6), "US-ASCII")), F.lit(0).cast("bigint"), price, unsigned(m, 17, 4, True), unsigned(m, 2, 6, True))
    return F.when((F.octet_length(m) >= PITCH_LENGTH) & (unsigned(m, 1, 1) == PITCH_TRADE), trade)


def decimal64(mantissa: Column, exponent: Column) -> Column:
    """mantissa * 10**exponent in units of 1e-8, truncated; null for exponents outside -16..0."""
    wide = mantissa.cast("decimal(38,0)")
    out = F.lit(None).cast("decimal(38,0)")
    for e in range(-16, 1):
        shift = e + 8
        power = F.lit(10 ** abs(shift)).cast("decimal(9,0)")
        out = F.when(exponent == e, (wide * power).cast("decimal(38,0)") if shift >= 0 else fixed.div(wide, power).cast("decimal(38,0)")).otherwise(out)
    return out


def cme_entries(m: Column) -> Column:
    """All trade entries of a little-endian incremental refresh, in order; null for another message, entries that are cut are left out."""
    group = F.lit(CME_HEADER).cast("bigint") + unsigned(m, 0, 2)
    size, count, first = unsigned(m, group, 2), unsigned(m, group + 2, 1), group + 3
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: first + i * size)
    whole = F.filter(at, lambda o: (o + CME_ENTRY_TYPE_AT < F.octet_length(m)) & (unsigned(m, o + CME_ENTRY_TYPE_AT, 1) == CME_TRADE))
    entry = lambda o: _trade(CME_EXCHANGE, signed(m, o + 13, 4), unsigned(m, o + 17, 4), decimal64(signed(m, o, 8), signed(m, o + 8, 1)), unsigned(m, o + 9, 4), unsigned(m, CME_HEADER, 8))
    is_trade = (F.octet_length(m) >= CME_LENGTH) & (unsigned(m, 2, 2) == CME_TEMPLATE)
    fits = is_trade & (group + 3 <= F.octet_length(m))
    return F.when(fits & (count > 0), F.transform(whole, entry)).when(is_trade, F.array().cast("array<struct<symbol_key:string,sequence:bigint,exchange_id:smallint,price_e8:bigint,quantity:int,exchange_ts_nanos:bigint>>"))


PARSERS = {"itch": itch, "xdp": xdp, "pitch": pitch}


def map_symbols(trades: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ticks of the parsed ``trades`` (columns message_id, receive_ts_nanos, trade); ``symbols`` has symbol_key, instrument_id and partition."""
    flat = trades.where("trade IS NOT NULL").select("message_id", "receive_ts_nanos", "trade.*")
    keys = symbols.select(F.rtrim("symbol_key").alias("symbol_key"), "instrument_id", "partition")
    return flat.join(keys, "symbol_key").select("message_id", "sequence", "instrument_id", "exchange_id", "price_e8", "quantity", "exchange_ts_nanos", "receive_ts_nanos", "partition", F.lit(fixed.TRADE).cast("tinyint").alias("flags"))


def parse(messages: DataFrame, protocol: str, symbols: DataFrame) -> DataFrame:
    """Ticks of ``messages`` (columns message_id, message, receive_ts_nanos), one at most for each message.

    Of a message with many entries the first one counts whose security is mapped.
    """
    if protocol != "cme":
        return map_symbols(messages.withColumn("trade", let(F.col("message"), PARSERS[protocol])), symbols)
    entries = messages.select("message_id", "receive_ts_nanos", F.posexplode(let(F.col("message"), cme_entries)).alias("nth", "trade"))
    ticks = map_symbols(entries.select(F.struct("message_id", "nth").alias("message_id"), "receive_ts_nanos", "trade"), symbols)
    columns = [c for c in ticks.columns if c != "message_id"]
    first = ticks.groupBy(F.col("message_id.message_id").alias("message_id")).agg(F.min_by(F.struct(*columns), "message_id.nth").alias("t"))
    return first.select("message_id", "t.*")
