"""Operator 11, WARC archives: a writer that stores equal payloads once, and a splittable reader.

The writer makes one gzip member a record: a ``response`` is an HTTP head and the payload, a ``revisit`` the head alone, with
the payload's digest and what it refers to. Which record of equal payloads is the response follows from one aggregate of
digests; digests that occur once are not joined. Each task writes archives of up to FILE bytes to the shared folder and
returns their names; only archives so named are read, so what a lost attempt left is never seen.

The reader deals byte ranges to tasks. A task looks for gzip magic in its range, takes a place for a record if what
inflates there begins with a WARC head that parses, and owns the records that start in its range, whose bytes it follows
beyond the range's end. The search goes on behind a record's end, or one byte on from a place that is none. A range that
begins inside a record whose payload holds a whole archive in stored blocks finds records that are payload; such a place
lies inside a record of another range, so what starts before the end of an earlier record of its file is dropped.

Defined results: a null payload is an empty one, and empty payloads are equal like others; a null page_id is never the
greatest, so such a row is a revisit where an equal payload has a page_id, and a response (without one) elsewhere; all rows
that share the greatest page_id of a payload are responses, so repeated rows are; a null url is stored as ``urn:unknown``, and
characters that a head cannot hold are percent-encoded; payloads of any length are read in pieces, of which a digest is
kept; ``write_warc`` and ``read_warc`` hold one record's payload at a time; further columns are
passed over; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, record_batch, table
from .shared import SPLIT, byte_ranges, new_folder, store, task_file

# The format's version, its profile of revisits and the gzip magic.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"

RESPONSE, REVISIT = "response", "revisit"

#: Bytes after which a task begins another archive, and that are read at once.
FILE, PIECE = 1 << 30, 1 << 18

#: Bytes that are inflated at once.
STEP = 1 << 14

#: Bytes that a head may have; what goes on longer is no record.
HEAD = 1 << 16

DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}').urn}>"


def _head(first: bytes, fields: dict[str, object]) -> bytes:
    return first + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit if it ``refers_to`` a page."""
    http = _head(b"HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    revisit = refers_to is not None
    block = [http] if revisit else [http, payload]
    fields = {
        "WARC-Type": REVISIT if revisit else RESPONSE,
        "WARC-Record-ID": record_id(page_id, payload_digest),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else "urn:unknown",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to, payload_digest) if revisit else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": sum(map(len, block)),
    }
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([press.compress(_head(VERSION, fields)), *map(press.compress, block), press.compress(b"\r\n\r\n"), press.flush()])


def with_references(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every page; ``refers_to`` is null for responses."""
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", data.alias("payload"), F.sha1(data).alias("digest"))
    # the greatest page_id of each digest is combined in each task before it is shuffled; of most digests there is one row, which needs no join
    first = own.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = own.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, limit: int = FILE) -> DataFrame:
    """(path, size, n) of the archives that hold ``records`` (page_id, url, payload, digest as hexadecimal, refers_to); written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        where.create_dir(path, recursive=True)
        out, name, size, n, number = None, "", 0, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):  # one payload at a time
                page_id, url, payload, hexed, refers_to = (c[row].as_py() for c in batch.columns)
                if out is None:
                    name, size, n = task_file(number, ".warc.gz"), 0, 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(hexed)).decode(), refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= limit:
                    out.close()
                    out, number = None, number + 1
                    yield record_batch({"path": ([f"{folder}/{name}"], pa.string()), "size": ([size], pa.int64()), "n": ([n], pa.int64())})
        if out is not None:
            out.close()
            yield record_batch({"path": ([f"{folder}/{name}"], pa.string()), "size": ([size], pa.int64()), "n": ([n], pa.int64())})

    return cut(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, size bigint, n bigint"))


class Record(NamedTuple):
    offset: int
    end: int
    fields: dict[str, str]
    http: bytes
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class Source:
    """A file that is read forwards in pieces of PIECE bytes, of which one is kept."""

    def __init__(self, handle):
        self.handle, self.base, self.data = handle, 0, b""

    def at(self, place: int) -> bytes:
        """Some bytes from a place on; none at the file's end."""
        if not self.base <= place < self.base + len(self.data):
            self.handle.seek(place)
            self.base, self.data = place, self.handle.read(PIECE)
        return self.data[place - self.base : place - self.base + STEP]

    def find(self, start: int, stop: int) -> int | None:
        """The first place in start..stop where the magic begins."""
        while start < stop:
            if not self.at(start):
                return None
            found = self.data.find(MAGIC, start - self.base)
            if found >= 0:
                return self.base + found if self.base + found < stop else None
            end = self.base + len(self.data)
            if len(self.data) < PIECE:
                return None
            start = max(end - len(MAGIC) + 1, start)  # the magic may lie across the end of a piece
            self.base, self.data = start, b""
        return None


class _Member:
    """The inflated bytes of a gzip member, in pieces; ``end`` is where the member ends, once it has."""

    def __init__(self, source: Source, offset: int):
        self.source, self.place, self.end = source, offset, None
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        """At most PIECE further bytes; nothing at the member's end. Raises zlib.error where the stream is none."""
        while self.end is None:
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.source.at(self.place)
                self.place += len(data)
                if not data:
                    raise zlib.error("the file ends in a member")
            out = self.inflate.decompress(data, PIECE)
            if self.inflate.eof:
                self.end = self.place - len(self.inflate.unused_data)
            if out:
                return out
        return b""


_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def parse_head(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC head (without its empty line), by lower-case name; None if it is none."""
    first, _, rest = data.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        return None
    fields, at = {}, 0
    while at < len(rest):
        if (m := _FIELD.match(rest, at)) is None:
            return None
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    return fields if {"warc-type", "warc-record-id"} <= fields.keys() and fields.get("content-length", "").isdigit() else None


def read_record(source: Source, offset: int, payloads: bool = False) -> Record | None:
    """The record whose member starts at an offset; None if none does."""
    member = _Member(source, offset)
    try:
        data = member.more()
        while b"\r\n\r\n" not in data and data.startswith((b"WARC/", b"WARC/"[: len(data)])) and len(data) < HEAD:
            if not (more := member.more()):
                return None
            data += more
        head, gap, rest = data.partition(b"\r\n\r\n")
        if not gap or (fields := parse_head(head + b"\r\n")) is None:
            return None
        left = int(fields["content-length"])
        block = fields.get("content-type", "").startswith("application/http")
        http, sha, size, kept = b"", hashlib.sha1(usedforsecurity=False), 0, []
        in_head = block
        while True:
            own, rest = rest[:left], rest[left:]
            left -= len(own)
            if in_head:
                http += own
                if b"\r\n\r\n" in http:
                    http, _, own = http.partition(b"\r\n\r\n")
                    in_head = False
                else:
                    own = b""
            sha.update(own)
            size += len(own)
            if payloads:
                kept.append(own)
            if not left:
                break
            if not (rest := member.more()):
                return None
        tail = rest
        while more := member.more():
            tail += more
            if len(tail) > 4:
                return None
        if tail != b"\r\n\r\n":
            return None
    except zlib.error:
        return None
    return Record(offset, member.end, fields, http, size, base64.b32encode(sha.digest()).decode(), b"".join(kept) if payloads else None)


def records_in(source: Source, start: int, stop: int) -> Iterator[Record]:
    """Records that start in start..stop of a file; bytes are read beyond it as far as the last of them goes."""
    while (at := source.find(start, stop)) is not None:
        if (r := read_record(source, at)) is None:
            start = at + 1
        else:
            yield r
            start = r.end


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def _row(address: str, r: Record) -> tuple:
    declared, named = _LENGTH.search(r.http), r.fields.get("warc-payload-digest", "")
    return address, r.offset, r.end, r.fields["warc-type"], r.fields["warc-record-id"], r.fields.get("warc-target-uri"), int(r.fields["content-length"]), r.payload_bytes, r.payload_digest, int(declared[1]) if declared else None, named.removeprefix("sha1:") or None, _number(r.fields, "x-page-id"), _number(r.fields, "x-refers-to-page-id")


INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64())])
SCHEMA = "path string, offset bigint, end bigint, record_type string, record_id string, target_uri string, content_length bigint, payload_bytes bigint, payload_digest string, declared_bytes bigint, declared_digest string, page_id bigint, refers_to bigint"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def index_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Every record of archives (path, size): its place, fields, and the bytes and digest of its payload as read. The declared
    ones are what the heads say of the full payload, which a revisit does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, path = store(address)
                with where.open_input_file(path) as handle:
                    rows = (_row(address, r) for r in records_in(Source(handle), start, stop))
                    while some := list(itertools.islice(rows, 2000)):
                        yield _batch(some, INDEX)

    found = byte_ranges(files, split).mapInArrow(run, SCHEMA)
    # what starts inside an earlier record of its file is payload; a row has a record's fields, not its payload
    before = F.max("end").over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("__before", before).where("__before IS NULL OR offset >= __before").drop("__before")


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Every record with its ``payload``: the index first, then each record at its place, one payload at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = address = None
        for batch in batches:
            rows, held = [], 0
            for row in range(batch.num_rows):
                path, offset = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if path != address:
                    where, inner = store(path)
                    address, handle = path, Source(where.open_input_file(inner))
                r = read_record(handle, offset, payloads=True)
                rows.append((*_row(path, r), r.payload))
                held += r.payload_bytes
                if held >= 4 * PIECE:
                    yield _batch(rows, whole)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, whole)

    whole = INDEX.append(pa.field("payload", pa.binary()))
    places = index_warc(files, split).select("path", "offset", F.floor(F.col("offset") / split).alias("range"))
    return places.repartition("path", "range").sortWithinPartitions("path", "offset").drop("range").mapInArrow(run, f"{SCHEMA}, payload binary")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(with_references(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    read = index_warc(archives)
    full = lambda name: F.when(F.col("record_type") == REVISIT, F.col(f"declared_{name}")).otherwise(F.col(f"payload_{name}"))
    return read.select("page_id", full("bytes").alias("payload_bytes"), full("digest").alias("payload_digest"), "record_type", "refers_to")


#: DuckDB has no base32: each five of a digest's hexadecimal digits make four of its characters.
ORACLE = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d"""
