"""Operator 8, binary output in training order: a keyed permutation gives every sequence a global slot.

Token ids are bytes (UTF-8; 255, which UTF-8 never uses, pads), one byte each. A document's ids are cut into sequences
of SEQUENCE ids, which are numbered without gaps: documents are dealt into hashed buckets, and a sequence's number is
the total of the buckets before, of which there are at most BUCKETS, plus its place in its bucket. A Feistel network
over the least even number of bits, walked until it lands below the number of sequences, maps numbers to slots one to
one. Slots are dealt to partitions by range, and shards are runs of records of one stride, so that any slot is found by
arithmetic and reading can begin anywhere.

A record is doc_id, piece and number of ids (little-endian 64, 32 and 32 bits, then 16 bytes in all) and the padded ids.

Defined results: a null or empty text is one sequence without ids; a null doc_id is stored as -2**63; rows that repeat get
slots of their own; texts that share doc_id and text are ties, whose numbers follow in no set order, but their records are equal;
texts of any length are cut whole; further columns, whatever their names, are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, shuffle_partitions, table

SEQUENCE = 2048
HEAD = struct.Struct("<qii")
STRIDE = HEAD.size + SEQUENCE
SHARD_RECORDS = 512
BUCKETS = 4096
ROUNDS = 6
KEY = 20240229
PAD = 255
NO_ID = -(1 << 63)


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The images of numbers below ``n`` under a keyed permutation of 0..n-1."""
    half = max((max(n - 1, 1).bit_length() + 1) // 2, 1)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix64(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key & (1 << 63) - 1))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]  # walk on along the cycle
    return out.astype(np.int64)


def n_sequences(size: int) -> int:
    return max(-(-size // SEQUENCE), 1)


def sequences(docs: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """(slot, doc_id, piece, ids) of every sequence, and their number."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("own"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "own"), F.lit(BUCKETS)).cast("int"))
    pieces = F.greatest(F.ceil(F.octet_length("text") / SEQUENCE), F.lit(1)).cast("bigint")
    totals = dict(own.groupBy("bucket").agg(F.sum(pieces)).collect())  # at most BUCKETS rows
    first, n = {}, 0
    for bucket in sorted(totals):
        first[bucket], n = n, n + totals[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number = None, 0
        for batch in batches:
            ids, piece, of, at = [], [], [], []
            for i, (b, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if b != bucket:
                    bucket, number = b, first[b]
                data = t.encode("utf-8", "surrogatepass")
                for k in range(n_sequences(len(data))):
                    ids.append(data[k * SEQUENCE : (k + 1) * SEQUENCE])
                    piece.append(k)
                    of.append(i)
                    at.append(number)
                    number += 1
            slots = feistel(np.asarray(at, np.int64), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(2).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "doc_id", "piece", "ids"])

    dealt = own.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "own").select("bucket", "text", "doc_id")
    return dealt.mapInArrow(run, "slot bigint, doc_id bigint, piece int, ids binary"), n


def record(doc_id: int, piece: int, ids: bytes) -> bytes:
    return HEAD.pack(doc_id, piece, len(ids)) + ids.ljust(SEQUENCE, bytes([PAD]))


def read_record(data: bytes, i: int) -> tuple[int, int, bytes]:
    """(doc_id, piece, ids) of the i-th record of a shard."""
    doc_id, piece, n = HEAD.unpack_from(data, i * STRIDE)
    start = i * STRIDE + HEAD.size
    return doc_id, piece, data[start : start + n]


def shards(docs: DataFrame, key: int = KEY, records: int = SHARD_RECORDS) -> DataFrame:
    """(shard, first_slot, n_records, data): runs of ``records`` records in the order of their slots, each of STRIDE bytes."""
    rows, n = sequences(docs, key)
    n_shards = max(-(-n // records), 1)
    parts = min(shuffle_partitions(docs.sparkSession), n_shards)
    part = F.floor(F.floor(F.col("slot") / records) * parts / n_shards).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        shard = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([shard * records], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["shard", "first_slot", "n_records", "data"])

        for batch in batches:
            for slot, doc_id, piece, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot // records != shard:
                    if held:
                        yield out()
                    held, shard = [], slot // records
                held.append(record(doc_id, piece, ids))
        if held:
            yield out()

    ranged = rows.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("slot")
    return ranged.select("slot", "doc_id", "piece", "ids").mapInArrow(run, "shard bigint, first_slot bigint, n_records int, data binary")


def write_shards(docs: DataFrame, path: str, key: int = KEY, records: int = SHARD_RECORDS) -> None:
    shards(docs, key, records).write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, records: int = SHARD_RECORDS) -> DataFrame:
    """The records from a slot on: shards before it are not read."""
    return records_of(spark.read.parquet(path).where(F.col("shard") >= slot // records)).where(F.col("slot") >= slot)


def records_of(shards_: DataFrame) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, piece, n_tokens, ids) of every record of shards, read at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [read_record(data, i) for i in range(n)]
                columns = [pa.array(range(first, first + n), pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([i * STRIDE for i in range(n)], pa.int64()), pa.array([None if d == NO_ID else d for d, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([len(x) for _, _, x in found], pa.int32()), pa.array([x for _, _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids"])

    return shards_.select("shard", "first_slot", "n_records", "data").mapInArrow(run, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece int, n_tokens int, ids binary")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records_of(shards(table(spark, sf_dir, "documents")))
    return out.select("slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", F.crc32("ids").alias("ids_crc32"))
