"""A demonstration catalog of instruments, indexes and constituents, as small DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed

# Instruments (id, symbol, initial price), all GBP on XLON, exchange 1, and active.
INSTRUMENTS = [
    (1, "LSEG", 9_300_000_000),
    (2, "VOD", 78_000_000),
    (3, "AZN", 12_400_000_000),
    (4, "HSBA", 790_000_000),
    (5, "BP", 510_000_000),
    (6, "SHEL", 2_850_000_000),
    (7, "ULVR", 4_640_000_000),
    (8, "GSK", 1_635_000_000),
]

# Weights of each index by instrument.
WEIGHTS = {
    100: {1: 18_000_000, 2: 7_500_000, 3: 19_000_000, 4: 11_500_000, 5: 10_500_000, 6: 14_000_000, 7: 11_000_000, 8: 8_500_000},
    101: {1: 25_000_000, 2: 15_000_000, 3: 35_000_000, 4: 25_000_000},
    102: {5: 20_000_000, 6: 30_000_000, 7: 25_000_000, 8: 25_000_000},
}

CONSTITUENT_SCHEMA = "index_id smallint, instrument_id int, weight_e8 bigint, initial_price_e8 bigint, placeholder boolean, shares bigint, free_float_e8 bigint, fx_rate_e8 bigint"
INSTRUMENT_SCHEMA = "instrument_id int, symbol string, primary_exchange_id smallint, currency string, venue_mic string, is_active boolean"
INDEX_SCHEMA = "index_id smallint, code string, currency string, methodology string, version bigint, effective_from_nanos bigint"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that the optimiser knows the rows of."""
    fields = T._parse_datatype_string(schema).fields
    columns = {f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns))


def instruments(spark: SparkSession) -> DataFrame:
    return local(spark, [(i, s, 1, "GBP", "XLON", True) for i, s, _ in INSTRUMENTS], INSTRUMENT_SCHEMA)


def constituents(spark: SparkSession) -> DataFrame:
    prices = {i: p for i, _, p in INSTRUMENTS}
    rows = [(x, i, w, prices[i], False, 0, fixed.SCALE, fixed.SCALE) for x, by in WEIGHTS.items() for i, w in by.items()]
    return local(spark, rows, CONSTITUENT_SCHEMA)


def indexes(spark: SparkSession) -> DataFrame:
    return local(spark, [(x, f"IDX{x}", "GBP", "WeightedPrice", 1, 1) for x in WEIGHTS], INDEX_SCHEMA)


def many_constituents(spark: SparkSession, n_indexes: int = 64, each: int = 8, n_instruments: int = 256) -> DataFrame:
    """Many indexes over many instruments, for routing at width."""
    grid = spark.range(n_indexes * each).select(F.floor(F.col("id") / each).alias("x"), (F.col("id") % each).alias("c"))
    instrument = ((F.col("x") * 4 + F.col("c")) % n_instruments + 1).cast("int")
    return grid.select((F.col("x") + 1000).cast("smallint").alias("index_id"), instrument.alias("instrument_id"), F.lit(fixed.SCALE // each).cast("bigint").alias("weight_e8"), (F.lit(9_350_000_000) + instrument).alias("initial_price_e8"))
