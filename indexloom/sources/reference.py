"""Reference data derived from the business tables: parts are instruments, suppliers are indexes, line items are constituents,
and nations give exchange rates. ``faulty`` data break every rule of validation, by rules on the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

CURRENCIES = ["GBP", "USD", "EUR"]

#: The version and start that all of a snapshot's indexes should have.
VERSION = EFFECTIVE = 1

#: Line items that one task gets, or fewer.
ROWS = 1 << 18


def _currency(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CURRENCIES)), (n % 3 + 1).cast("int"))


def _is(key: str, modulus: int, rest: int) -> Column:
    return F.col(key) % modulus == rest


def instruments(spark: SparkSession, sf_dir: str, faulty: bool = True) -> DataFrame:
    k = F.col("p_partkey")
    bad = lambda m, r: _is("p_partkey", m, r) if faulty else F.lit(False)
    text = k.cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(bad(97, 5), -k).when(bad(89, 7), k).otherwise(k + 1).alias("instrument_id"),
        F.when(bad(83, 3), " ").when(bad(79, 2), F.concat(F.lit("p"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("P"), text)).alias("symbol"),
        F.when(bad(73, 4), "").otherwise(_currency(F.col("p_size"))).alias("currency"),
        (~bad(71, 6)).alias("is_active"),
    )


def indexes(spark: SparkSession, sf_dir: str, faulty: bool = True) -> DataFrame:
    j = F.col("s_suppkey")
    bad = lambda m, r: _is("s_suppkey", m, r) if faulty else F.lit(False)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.when(bad(7, 3), -j).when(bad(11, 4), j).otherwise(j + 1).alias("index_id"),
        F.when(bad(13, 5), "").when(bad(17, 6), F.concat(F.lit("idx"), (j - 1).cast("string"))).otherwise(F.concat(F.lit("IDX"), j.cast("string"))).alias("code"),
        F.when(bad(19, 7), " ").otherwise(_currency(F.col("s_nationkey"))).alias("currency"),
        F.when(j % 5 == 0, "FloatAdjustedMarketCap").otherwise("WeightedPrice").alias("methodology"),
        F.when(bad(23, 8), VERSION + 1).otherwise(VERSION).cast("bigint").alias("version"),
        F.when(bad(29, 9), EFFECTIVE + 1).otherwise(EFFECTIVE).cast("bigint").alias("effective_from_nanos"),
    )


def constituents(spark: SparkSession, sf_dir: str, faulty: bool = True) -> DataFrame:
    """One for each part that a supplier's line items name (faulty: one a line item). Weights are equal; the first (all of those that share its place) takes the rest.

    Rows are dealt out by index, ROWS a task or so, and stay so in what joins and groups them by index.
    """
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS))
    lines = table.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") + 1).alias("index_id"), F.col("l_quantity").cast("bigint").alias("shares"))
    dealt = lines.repartition(tasks, "index_id")
    if not faulty:
        first = dealt.groupBy("index_id", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "shares")).alias("f"))
        lines = dealt = first.select("index_id", "l_partkey", "f.*")
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    sizes = lines.groupBy("index_id").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    sizes = sizes.repartition(tasks, "index_id")  # else Spark deals the rows out as it does the sizes
    rows = dealt.join(sizes.hint("shuffle_hash"), "index_id").withColumn("h", place)  # only the sizes are held, and no rows are sorted
    bad = lambda m, r: _is("h", m, r) if faulty else F.lit(False)
    share = fixed.div(F.lit(fixed.SCALE), F.col("n"))
    whole = F.when(F.col("h") == F.col("first"), F.lit(fixed.SCALE) - share * (F.col("n") - 1)).otherwise(share)
    out = rows.select(
        "index_id",
        F.when(bad(239, 6), F.col("l_partkey") + 1_000_000_000).otherwise(F.col("l_partkey") + 1).alias("instrument_id"),
        F.when(bad(223, 2), -1).otherwise(whole).cast("bigint").alias("weight_e8"),
        F.when(bad(211, 1), 0).otherwise((F.col("l_orderkey") % 1000 + 1) * 1_000_000).cast("bigint").alias("initial_price_e8"),
        (F.col("h") % 2 == 0).alias("placeholder"),
        F.when(bad(233, 5), 0).otherwise(F.col("shares")).cast("bigint").alias("shares"),
        F.when(bad(227, 3), fixed.SCALE + 1).otherwise(fixed.SCALE).cast("bigint").alias("free_float_e8"),
        F.when(bad(229, 4), 0).otherwise(fixed.SCALE).cast("bigint").alias("fx_rate_e8"),
    )
    return out.where((F.col("index_id") - 1) % 31 != 10) if faulty else out


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(_currency(n).alias("from_currency"), _currency(n + 1).alias("to_currency"), F.when(n % 4 == 0, 0).otherwise((n + 1) * 10_000_000).cast("bigint").alias("rate_e8"))


_SQL_CURRENCY = "['GBP', 'USD', 'EUR'][({}) % 3 + 1]"

#: The same tables for DuckDB: inst, idx, con, fx.
FAULTY_SQL = f"""inst AS (SELECT CASE WHEN p_partkey % 97 = 5 THEN -p_partkey WHEN p_partkey % 89 = 7 THEN p_partkey ELSE p_partkey + 1 END AS instrument_id,
  CASE WHEN p_partkey % 83 = 3 THEN ' ' WHEN p_partkey % 79 = 2 THEN 'p' || (p_partkey - 1) ELSE 'P' || p_partkey END AS symbol,
  CASE WHEN p_partkey % 73 = 4 THEN '' ELSE {_SQL_CURRENCY.format('p_size')} END AS currency, p_partkey % 71 <> 6 AS is_active FROM part),
idx AS (SELECT CASE WHEN s_suppkey % 7 = 3 THEN -s_suppkey WHEN s_suppkey % 11 = 4 THEN s_suppkey ELSE s_suppkey + 1 END AS index_id,
  CASE WHEN s_suppkey % 13 = 5 THEN '' WHEN s_suppkey % 17 = 6 THEN 'idx' || (s_suppkey - 1) ELSE 'IDX' || s_suppkey END AS code, CASE WHEN s_suppkey % 19 = 7 THEN ' ' ELSE {_SQL_CURRENCY.format('s_nationkey')} END AS currency,
  CASE WHEN s_suppkey % 5 = 0 THEN 'FloatAdjustedMarketCap' ELSE 'WeightedPrice' END AS methodology, CASE WHEN s_suppkey % 23 = 8 THEN 2 ELSE 1 END AS version, CASE WHEN s_suppkey % 29 = 9 THEN 2 ELSE 1 END AS effective_from_nanos FROM supplier),
h AS (SELECT *, l_orderkey * 8 + l_linenumber AS h, count(*) OVER (PARTITION BY l_suppkey) AS n, min(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY l_suppkey) AS first FROM lineitem),
con AS (SELECT l_suppkey + 1 AS index_id, CASE WHEN h % 239 = 6 THEN l_partkey + 1000000000 ELSE l_partkey + 1 END AS instrument_id,
  CASE WHEN h % 223 = 2 THEN -1 WHEN h = first THEN 100000000 - 100000000 // n * (n - 1) ELSE 100000000 // n END AS weight_e8, CASE WHEN h % 211 = 1 THEN 0 ELSE (l_orderkey % 1000 + 1) * 1000000 END AS initial_price_e8,
  h % 2 = 0 AS placeholder, CASE WHEN h % 233 = 5 THEN 0 ELSE l_quantity::BIGINT END AS shares, CASE WHEN h % 227 = 3 THEN 100000001 ELSE 100000000 END AS free_float_e8, CASE WHEN h % 229 = 4 THEN 0 ELSE 100000000 END AS fx_rate_e8
  FROM h WHERE l_suppkey % 31 <> 10),
fx AS (SELECT {_SQL_CURRENCY.format('n_nationkey')} AS f, {_SQL_CURRENCY.format('n_nationkey + 1')} AS t FROM nation WHERE n_nationkey % 4 <> 0)"""
