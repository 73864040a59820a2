"""Validation of reference data: every broken rule as a row (rule, entity, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

DENSITY = 4


class ReferenceDataError(ValueError):
    """Reference data breaks rules; ``errors`` has the messages."""

    def __init__(self, errors: list[str]):
        super().__init__("Reference data is invalid: " + "; ".join(errors))
        self.errors = errors


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


Rule = tuple[str, Column | str, Column, str, tuple[Column | str, ...]]


def _rule(name: str, broken: Column | str, entity: Column, message: str, *values: Column | str) -> Rule:
    return name, broken, entity, message, values


def _rows(df: DataFrame, *rules: Rule) -> DataFrame:
    """A row for each rule that a row of ``df`` breaks, in one pass."""
    found = []
    for name, broken, entity, message, values in rules:
        text = F.format_string(message, *[F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")) for v in values])
        found.append(F.when(F.expr(broken) if isinstance(broken, str) else broken, F.struct(F.lit(name).alias("rule"), entity.cast("string").alias("entity"), text.alias("message"))))
    return df.select(F.inline(F.array_compact(F.array(*found))))


def _repeated(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def validate(version: int, effective_from_nanos: int, instruments: DataFrame, indexes: DataFrame, constituents: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """All broken rules of one snapshot; ``fx_rates`` has from_currency, to_currency and rate_e8.

    Constituents go past hash tables of indexes and of instruments, so tasks hold parts of these tables and sort no constituents.
    """
    spark = instruments.sparkSession
    one = spark.range(1)
    counts = instruments.agg(F.count("*").alias("n"), F.max("instrument_id").alias("i")).crossJoin(indexes.agg(F.count("*").alias("x"))).crossJoin(constituents.agg(F.max("instrument_id").alias("c")))  # one row each
    top = counts.withColumn("top", F.greatest(F.coalesce("i", F.lit(-1)), F.coalesce("c", F.lit(-1))))
    snapshot = F.lit("snapshot")
    # The messages of the rules.
    found = [
        _rows(one, _rule("V1", F.lit(version <= 0), snapshot, "Reference data version must be positive.")),
        _rows(
            top,
            _rule("V2", "n = 0", snapshot, "Reference data must contain at least one instrument."),
            _rule("V3", "x = 0", snapshot, "Reference data must contain at least one index."),
            _rule("V4", F.col("top") > F.col("n") * DENSITY, snapshot, "Instrument ids must be normalized to dense internal ids for array indexing; count=%s, maxId=%s.", "n", "top"),
        ),
        _rows(
            instruments,
            _rule("V5", "instrument_id <= 0", F.col("symbol"), "Instrument '%s' has non-positive instrument id %s.", "symbol", "instrument_id"),
            _rule("V7", (F.col("instrument_id") > 0) & _blank("symbol"), F.col("instrument_id"), "Instrument id %s is missing symbol.", "instrument_id"),
            _rule("V9", (F.col("instrument_id") > 0) & _blank("currency"), F.col("symbol"), "Instrument '%s' is missing currency.", "symbol"),
        ),
    ]
    valid = instruments.where("instrument_id > 0")
    named = valid.where(~_blank("symbol"))
    key, always = F.col("key"), F.lit(True)
    found += [
        _rows(_repeated(valid, F.col("instrument_id")), _rule("V6", always, key, "Duplicate instrument id %s.", "key")),
        _rows(_repeated(named, F.upper("symbol")), _rule("V8", always, key, "Duplicate instrument symbol '%s'.", "key")),
        _rows(_repeated(indexes.where("index_id > 0"), F.col("index_id")), _rule("V11", always, key, "Duplicate index id %s.", "key")),
        _rows(_repeated(indexes.where(~_blank("code")), F.upper("code")), _rule("V13", always, key, "Duplicate index code '%s'.", "key")),
        _rows(
            indexes,
            _rule("V10", "index_id <= 0", F.col("code"), "Index '%s' has non-positive index id %s.", "code", "index_id"),
            _rule("V12", _blank("code"), F.col("index_id"), "Index id %s is missing code.", "index_id"),
            _rule("V14", _blank("currency"), F.col("code"), "Index '%s' is missing currency.", "code"),
            _rule("V15", (F.col("version") > 0) & (F.col("version") != version), F.col("code"), "Index '%s' version %s does not match snapshot version %s.", "code", "version", F.lit(version)),
            _rule("V16", (F.col("effective_from_nanos") > 0) & F.lit(effective_from_nanos > 0) & (F.col("effective_from_nanos") != effective_from_nanos), F.col("code"), "Index '%s' effective timestamp does not match snapshot timestamp.", "code"),
        ),
        _rows(indexes.join(constituents.select("index_id").distinct(), "index_id", "left_anti"), _rule("V17", always, F.col("code"), "Index '%s' must contain at least one constituent.", "code")),
    ]
    by_index = constituents.join(indexes.select("index_id", "code", F.col("currency").alias("index_currency"), "methodology").hint("shuffle_hash"), "index_id")
    facts = valid.repartition("instrument_id").groupBy("instrument_id").agg(F.max_by("currency", "symbol").alias("currency"), F.max("is_active").alias("is_active"))
    rates = fx_rates.where("rate_e8 > 0").select(F.upper("from_currency").alias("f"), F.upper("to_currency").alias("t"), F.lit(True).alias("covered")).distinct()
    # each constituent with its instrument, if that is known, and its exchange rate, if there is one
    known = by_index.join(facts.withColumn("known", F.lit(True)).hint("shuffle_hash"), "instrument_id", "left").join(rates, (F.upper("currency") == F.col("f")) & (F.upper("index_currency") == F.col("t")), "left")
    foreign = ~F.coalesce(F.upper("currency"), F.lit("")).eqNullSafe(F.coalesce(F.upper("index_currency"), F.lit("")))
    uncovered = foreign & (F.col("covered").isNull() | _blank("currency") | _blank("index_currency"))
    entity, item = F.col("code"), "Index '%s' constituent %s "
    on_known = lambda name, broken, message, *values: _rule(name, F.col("known").isNotNull() & (F.expr(broken) if isinstance(broken, str) else broken), entity, message, *values)
    repeated = by_index.groupBy("index_id", "code", "instrument_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = repeated.join(valid.select("instrument_id").hint("shuffle_hash"), "instrument_id", "left_semi")
    total = by_index.groupBy("index_id", "code", "methodology").agg(F.sum(F.when(F.col("weight_e8") > 0, F.col("weight_e8")).otherwise(0)).alias("w"))
    found += [
        _rows(twice, _rule("V19", always, entity, "Index '%s' has duplicate constituent instrument id %s.", "code", "instrument_id")),
        _rows(
            known,
            _rule("V18", F.col("known").isNull(), entity, "Index '%s' references unknown instrument id %s.", "code", "instrument_id"),
            on_known("V20", "NOT is_active AND NOT placeholder", "Index '%s' references inactive instrument id %s.", "code", "instrument_id"),
            on_known("V21", "initial_price_e8 <= 0", item + "has non-positive initial price.", "code", "instrument_id"),
            on_known("V22", "weight_e8 < 0", item + "has negative weight.", "code", "instrument_id"),
            on_known("V23", ~F.col("free_float_e8").between(0, fixed.SCALE), item + "has invalid free-float factor.", "code", "instrument_id"),
            on_known("V24", "fx_rate_e8 <= 0", item + "has non-positive FX rate.", "code", "instrument_id"),
            on_known("V25", "methodology = 'FloatAdjustedMarketCap' AND shares <= 0", "Index '%s' market-cap constituent %s must have positive shares.", "code", "instrument_id"),
            on_known("V26", uncovered, item + "requires FX %s->%s.", "code", "instrument_id", "currency", "index_currency"),
        ),
        _rows(total, _rule("V27", (F.col("methodology") == "WeightedPrice") & (F.col("w") != fixed.SCALE), entity, "Index '%s' weighted-price constituents must sum to " + str(fixed.SCALE) + "; actual=%s.", "code", "w")),
    ]
    return reduce(DataFrame.unionByName, found)


def require_valid(version: int, effective_from_nanos: int, instruments: DataFrame, indexes: DataFrame, constituents: DataFrame, fx_rates: DataFrame) -> None:
    """Raises ReferenceDataError with all messages, of which a snapshot has few."""
    errors = [r.message for r in validate(version, effective_from_nanos, instruments, indexes, constituents, fx_rates).orderBy("rule", "entity").collect()]
    if errors:
        raise ReferenceDataError(errors)
