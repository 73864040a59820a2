"""Operator 6, media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds all magic bytes of all formats in one pass over a binary value. At each hit the format's
validator walks the structure (chunks, pages, boxes, blocks, with their lengths and checksums) and says where it ends;
a hit whose structure does not hold is no medium. A valid medium at offset 0 gives the value's type, whatever was
declared; valid media that start elsewhere are carved out, nested ones included.

A structure that is walked step by step depends on where a step begins alone, so what a walk finds holds for all places
that it passed: each place is looked at once for each format, however many hits there are. Marks that end a medium are
listed once for a value and looked up. A FLAC stream, whose frames do not tell their lengths, ends with the value.

``op6`` stores each text's bytes, padded, as the samples of an 8-bit mono WAVE file whose declared type is that of
unknown bytes; it corrects the type, and reads the samples back out of what the sniffer finds in the stored bytes.

Defined results: a null value has no type and no media; an empty or unknown value is ``application/octet-stream``; a null
text is stored as an empty one; values of any length are read whole; equal values (ties, repeated rows) give equal
results; where media start at one place, the longest comes first; an empty table gives an empty result; other columns,
whatever their names, pass through ``sniff_media`` untouched.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import free_name, slices, table

UNKNOWN = "application/octet-stream"
UNIT = 576
RATE = 8000

Found = tuple[str, int] | None


class Value:
    """A binary value with what validators have found out about it so far."""

    def __init__(self, data: bytes):
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.known: dict[object, dict[int, object]] = {}
        self.zero = (0, -1)

    def places(self, mark: bytes) -> list[int]:
        """All places of a mark that ends or heads a medium, found once."""
        if mark not in self.marks:
            out, i = [], self.data.find(mark)
            while i >= 0:
                out.append(i)
                i = self.data.find(mark, i + 1)
            self.marks[mark] = out
        return self.marks[mark]

    def next_place(self, mark: bytes, at: int) -> int | None:
        places = self.places(mark)
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else None

    def after_zero(self, at: int) -> int | None:
        """Behind the next zero byte; asked for at growing places, so that no byte is searched twice for long."""
        start, found = self.zero
        if not start <= at <= found:
            found = self.data.find(b"\0", at)
            found = len(self.data) if found < 0 else found
            self.zero = at, found
        return found + 1 if found < len(self.data) else None

    def walk(self, step: Callable[[bytes, int], tuple[bool, object]], at: int) -> object:
        """The result of stepping from ``at`` on. ``step`` gives (True, next place, further on) or (False, result)."""
        known = self.known.setdefault(step, {})
        passed, i = [], at
        while i not in known:
            passed.append(i)
            more, x = step(self.data, i)
            if not more:
                known[i] = x
                break
            i = x
        result = known[i]
        known.update(dict.fromkeys(passed, result))
        return result


def _png_step(b: bytes, i: int) -> tuple[bool, object]:
    if i + 12 > len(b):
        return False, None
    size, kind = struct.unpack_from(">I4s", b, i)
    end = i + 12 + size
    if end > len(b) or not kind.isalpha():
        return False, None
    return (False, end) if kind == b"IEND" else (True, end)


def _png(v: Value, at: int) -> Found:
    b = v.data
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR" or (end := v.walk(_png_step, at + 8)) is None:
        return None
    i = at + 8
    while i < end:  # checksums, once the lengths hold
        stop = i + 12 + struct.unpack_from(">I", b, i)[0]
        if zlib.crc32(memoryview(b)[i + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        i = stop
    return "image/png", end


def _jpeg_step(b: bytes, i: int) -> tuple[bool, object]:
    """Over segments, to where the scan begins."""
    if i + 4 > len(b) or b[i] != 0xFF:
        return False, None
    marker, size = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
    if size < 2 or not (0xC0 <= marker <= 0xFE) or marker in (0xD8, 0xD9):
        return False, None
    return (False, i + 2 + size) if marker == 0xDA else (True, i + 2 + size)


def _jpeg(v: Value, at: int) -> Found:
    scan = v.walk(_jpeg_step, at + 2)
    end = None if scan is None else v.next_place(b"\xff\xd9", scan)
    return None if end is None else ("image/jpeg", end + 2)


def _colours(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif_data_step(b: bytes, i: int) -> tuple[bool, object]:
    """Over blocks of data, to behind the empty one."""
    if i >= len(b):
        return False, None
    return (True, i + 1 + b[i]) if b[i] else (False, i + 1)


def _gif(v: Value, at: int) -> Found:
    if at + 13 > len(v.data):
        return None

    def step(b: bytes, i: int) -> tuple[bool, object]:
        kind = b[i] if i < len(b) else None
        if kind == 0x3B:
            return False, i + 1
        if kind == 0x21:
            data = i + 2
        elif kind == 0x2C and i + 10 < len(b):
            data = i + 11 + _colours(b[i + 9])
        else:
            return False, None
        after = v.walk(_gif_data_step, data)
        return (False, None) if after is None else (True, after)

    step = v.known.setdefault("gif", {}).setdefault(0, step)  # one function a value, so that its walks are known by it
    end = v.walk(step, at + 13 + _colours(v.data[at + 10]))
    return None if end is None else ("image/gif", end)


# RIFF forms, their types and the chunk that each must have.
RIFF_FORMS = {b"WAVE": ("audio/wav", (b"data",)), b"AVI ": ("video/x-msvideo", (b"LIST",)), b"WEBP": ("image/webp", (b"VP8 ", b"VP8L", b"VP8X"))}


def riff_chunks(b: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the chunks of a RIFF file; raises ValueError where they do not fill it."""
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i = at + 12
    while i < end:
        if i + 8 > end:
            raise ValueError("a chunk is cut")
        name, size = struct.unpack_from("<4sI", b, i)
        if i + 8 + size > end:
            raise ValueError("a chunk is too long")
        yield name, i + 8, i + 8 + size
        i += 8 + size + (size & 1)


def _riff(v: Value, at: int) -> Found:
    b = v.data
    form = RIFF_FORMS.get(b[at + 8 : at + 12])
    if form is None or at + 8 + struct.unpack_from("<I", b, at + 4)[0] > len(b):
        return None
    try:
        names = {name for name, _, _ in riff_chunks(b, at)}
    except ValueError:
        return None
    return (form[0], at + 8 + struct.unpack_from("<I", b, at + 4)[0]) if names & {*form[1]} else None


def _bmp(v: Value, at: int) -> Found:
    b = v.data
    if at + 26 > len(b):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", at + size) if not reserved and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(b) - at else None


def _ogg_step(b: bytes, i: int) -> tuple[bool, object]:
    if i + 27 > len(b) or b[i : i + 5] != b"OggS\0":
        return False, None
    n = b[i + 26]
    end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
    if end > len(b):
        return False, None
    return (False, end) if b[i + 5] & 4 else (True, end)


def _ogg(v: Value, at: int) -> Found:
    end = v.walk(_ogg_step, at)
    return None if end is None else ("audio/ogg", end)


def _flac_step(b: bytes, i: int) -> tuple[bool, object]:
    """Over blocks of metadata, to the first frame."""
    if i + 4 > len(b):
        return False, None
    after = i + 4 + int.from_bytes(b[i + 1 : i + 4], "big")
    return (False, after) if b[i] & 0x80 else (True, after)


def _flac(v: Value, at: int) -> Found:
    b = v.data
    if b[at + 4 : at + 8] not in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") or (frames := v.walk(_flac_step, at + 4)) is None:
        return None
    return ("audio/flac", len(b)) if b[frames : frames + 2] in (b"\xff\xf8", b"\xff\xf9") else None


def _pdf(v: Value, at: int) -> Found:
    if not v.data[at + 5 : at + 6].isdigit() or (first := v.next_place(b"%%EOF", at)) is None:
        return None
    header, ends = v.next_place(b"%PDF-", first), v.places(b"%%EOF")
    end = ends[(len(ends) if header is None else bisect.bisect_left(ends, header)) - 1]  # linearised or updated files have several
    start = v.next_place(b"startxref", at)
    return ("application/pdf", end + 5) if start is not None and start < end else None


def _zip_ends(v: Value) -> dict[int, int]:
    """Where the archives end whose end records hold, by where they start; the first end of each."""
    out, b = {}, v.data
    for i in v.places(b"PK\x05\x06"):
        if i + 22 <= len(b):
            size, offset, comment = struct.unpack_from("<IIH", b, i + 12)
            start = i - size - offset
            if start >= 0 and b[start + offset : start + offset + 4] == b"PK\x01\x02" and i + 22 + comment <= len(b):
                out.setdefault(start, i + 22 + comment)
    return out


def _zip(v: Value, at: int) -> Found:
    if "zip" not in v.known:
        v.known["zip"] = _zip_ends(v)
    end = v.known["zip"].get(at)
    return None if end is None else ("application/zip", end)


def _gzip(v: Value, at: int) -> Found:
    b = v.data
    if at + 18 > len(b) or (flags := b[at + 3]) > 0x1F:
        return None
    i = at + 10
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for text in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & text and (i := v.after_zero(i)) is None:
            return None
    i += flags & 2
    stream, crc, rest = zlib.decompressobj(-15), 0, b""
    try:
        while not stream.eof and (rest or i < len(b)):  # in pieces, so that what it holds is never whole in memory
            if not rest:
                rest, i = b[i : i + 4096], min(i + 4096, len(b))
            crc = zlib.crc32(stream.decompress(rest, 1 << 20), crc)
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    end = i - len(stream.unused_data)
    return ("application/gzip", end + 8) if stream.eof and end + 8 <= len(b) and struct.unpack_from("<I", b, end)[0] == crc else None


# Boxes that stand at the top of an MP4 file.
MP4_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"pdin", b"udta"}


def _mp4_size(b: bytes, i: int) -> int | None:
    """The size of a known box; None if there is none, 0 if it is cut."""
    size, name = struct.unpack_from(">I4s", b, i) if i + 8 <= len(b) else (0, b"")
    if name not in MP4_BOXES:
        return None
    if size == 1:
        size = int.from_bytes(b[i + 8 : i + 16], "big")
    elif size == 0:
        size = len(b) - i
    return size if 8 <= size <= len(b) - i else 0


def _mp4_step(b: bytes, i: int) -> tuple[bool, object]:
    """Over boxes, to behind the last; a box that is cut makes no medium."""
    size = _mp4_size(b, i)
    return (True, i + size) if size else (False, i if size is None else None)


def _mp4_media_step(b: bytes, i: int) -> tuple[bool, object]:
    """Over boxes, to one that holds media."""
    size = _mp4_size(b, i)
    if not size or b[i + 4 : i + 8] in (b"moov", b"mdat"):
        return False, bool(size)
    return True, i + size


def _mp4(v: Value, at: int) -> Found:
    end = v.walk(_mp4_step, at)
    return ("video/mp4", end) if end is not None and v.walk(_mp4_media_step, at) else None


# Magic bytes, how far into a medium they stand, and the validator.
SIGNATURES: list[tuple[bytes, int, Callable[[Value, int], Found]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"RIFF", 0, _riff),
    (b"BM", 0, _bmp),
    (b"OggS", 0, _ogg),
    (b"fLaC", 0, _flac),
    (b"%PDF-", 0, _pdf),
    (b"PK\x03\x04", 0, _zip),
    (b"\x1f\x8b\x08", 0, _gzip),
    (b"ftyp", 4, _mp4),
]


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, start, stop) of every valid medium in a value, by start."""
    found, v = set(), Value(value)
    ogg_until = 0  # the pages of a stream are no streams of their own
    for last, i in automaton().iter(value.decode("latin-1")):
        magic, depth, validate = SIGNATURES[i]
        start = last + 1 - len(magic) - depth
        if start < 0 or (validate is _ogg and start < ogg_until):
            continue
        if hit := validate(v, start):
            found.add((hit[0], start, hit[1]))
            if validate is _ogg:
                ogg_until = hit[1]
    return sorted(found, key=lambda x: (x[1], -x[2]))


def media_type(found: list[tuple[str, int, int]]) -> str:
    return next((kind for kind, start, _ in found if start == 0), UNKNOWN)


def sniff_media(df: DataFrame, value: str, declared: str | None = None) -> DataFrame:
    """``df`` with media_type, type_corrected (whether ``declared`` says otherwise) and carved (the media that start inside)."""
    at, said = df.columns.index(value), df.columns.index(declared) if declared else None
    names = []
    for wanted in ("media_type", "type_corrected", "carved"):
        names.append(free_name([*df.columns, *names], wanted))
    item = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            kinds, wrong, carved = [], [], []
            for i, b in enumerate(batch.column(at).to_pylist()):
                found = None if b is None else sniff(b)
                kinds.append(None if b is None else media_type(found))
                wrong.append(None if b is None or said is None else batch.column(said)[i].as_py() != kinds[-1])
                carved.append(None if b is None else [{"media_type": k, "start": a, "stop": z, "content": b[a:z]} for k, a, z in found if a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, arrow)], names=[*batch.schema.names, *names])

    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.BooleanType()), T.StructField(names[2], T.ArrayType(item))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(-(-len(data) // UNIT), 1) * UNIT - len(data))


def to_wave(payload: bytes) -> bytes:
    """A WAVE file of 8-bit mono samples."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def samples(wave: bytes, start: int) -> bytes:
    return next(wave[a:z] for name, a, z in riff_chunks(wave, start) if name == b"data")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAVE file of the padded bytes of text) and declared_type, which says that its type is unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in slices(batch.column(1)):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([len(d) for d in data], pa.int64()), pa.array([to_wave(pad(d)) for d in data], pa.binary()), pa.array([UNKNOWN] * len(data))], names=["doc_id", "n_bytes", "media", "declared_type"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary, declared_type string")


def read_media(stored: DataFrame) -> DataFrame:
    """The digests of what the sniffer finds in the column media of ``store_texts``, the type it gives, and how many media it carves."""
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_type", pa.string()), ("type_corrected", pa.bool_()), ("n_carved", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, values in slices(batch.column(2)):
                out = []
                for b, declared in zip(values, batch.column(3).slice(first, stop - first).to_pylist(), strict=True):
                    found = sniff(b)
                    whole = next((a for kind, a, z in found if kind == "audio/wav" and a == 0 and z == len(b)), None)
                    if whole is None:
                        raise ValueError("the stored bytes are no WAVE file")
                    payload, kind = samples(b, whole), media_type(found)
                    carved = [f"+{k}@{a}-{z}" for k, a, z in found if a]
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), kind + "".join(carved), kind, kind != declared, len(carved)))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), batch.column(1).slice(first, stop - first), *columns], names=["doc_id", "n_bytes", *schema.names])

    kinds = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, type_corrected boolean, n_carved bigint"
    return stored.select("doc_id", "n_bytes", "media", "declared_type").mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, {kinds}")


def op6_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents")))
