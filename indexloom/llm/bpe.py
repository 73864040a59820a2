"""Operator 9, byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Pre-tokenisation cuts text as ``public_tokenizers.PATTERN`` does, without a regular expression. Code points become
classes through a table; classes drive a small automaton whose steps are functions on its states. These functions and
all their products form a finite monoid, so that a prefix scan over the (associative) products of blocks of text gives
each block its starting state, and all blocks then step at once. Each step says whether a piece begins at this code
point or, once what follows has settled it, began at the one before.

Pieces are merged by rank, lowest first and leftmost first, and results are cached by piece in each Python worker.

Defined results: a null or empty text has no ids; texts of any length are encoded whole; special tokens are plain text;
repeated rows (ties) give equal rows; an empty table gives an empty result; other columns, whatever their names, pass through ``encode_documents`` untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import free_name, slices, table

#: Classes of code points. Letters that can stand in a contraction ('s 't 'm 'd, 're 've 'll) have classes of their own.
SINGLE, LETTER_R, LETTER_V, LETTER_L, LETTER_E, LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, END = range(12)

#: States: what the current piece is. QUOTED is a lone quote that began a piece; Q_R, Q_V, Q_L are that quote and the
#: first letter of a two-letter contraction; DONE is a whole contraction; ONE_ and MORE_ are white space of one or more
#: code points that ends in a blank or in something else.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, Q_R, Q_V, Q_L, DONE, ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE = range(13)
N_STATES, N_CLASSES = 13, 12

#: Outputs: a piece begins at this code point; a piece began at the one before.
HERE, BEFORE = 1, 2

SEPARATOR = sys.maxunicode + 1
BLOCK = 256


def _begin(c: int) -> int:
    """The state after the first code point of a piece."""
    if c <= LETTER:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, BLANK: ONE_BLANK, SPACE: ONE_SPACE, END: START}[c]


def _after_blank(c: int) -> int:
    """The state after a code point that joins a blank before it."""
    return IN_OTHERS if c == QUOTE else _begin(c)


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state and the output."""
    if c == END:
        return START, HERE | (BEFORE if state in (Q_R, Q_V, Q_L) else 0)
    fresh = (_begin(c), HERE)
    kind = _begin(c)
    if state == IN_LETTERS:
        return (IN_LETTERS, 0) if c <= LETTER else fresh
    if state == IN_NUMBERS:
        return (IN_NUMBERS, 0) if c == NUMBER else fresh
    if state == IN_OTHERS:
        return (IN_OTHERS, 0) if c in (OTHER, QUOTE) else fresh
    if state == QUOTED:
        if c in (OTHER, QUOTE):
            return IN_OTHERS, 0
        pending = {SINGLE: DONE, LETTER_R: Q_R, LETTER_V: Q_V, LETTER_L: Q_L}.get(c)
        return fresh if pending is None else (pending, 0)
    if state in (Q_R, Q_V, Q_L):
        if c == (LETTER_L if state == Q_L else LETTER_E):
            return DONE, 0
        return (IN_LETTERS, BEFORE) if c <= LETTER else (kind, BEFORE | HERE)
    if state in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE):
        if c in (BLANK, SPACE):
            return (MORE_BLANK if c == BLANK else MORE_SPACE), 0
        cut = BEFORE if state in (MORE_BLANK, MORE_SPACE) else 0
        return (_after_blank(c), cut) if state in (ONE_BLANK, MORE_BLANK) else (kind, cut | HERE)
    return fresh


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, from its general category."""
    out = np.full(SEPARATOR + 1, OTHER, np.uint8)
    for c in range(SEPARATOR):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LNZ":
            out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE
    out[[*range(9, 14), 0x85]] = SPACE  # controls that count as white space
    for letters, c in (("stmd", SINGLE), ("r", LETTER_R), ("v", LETTER_V), ("l", LETTER_L), ("e", LETTER_E), ("'", QUOTE), (" ", BLANK)):
        out[[ord(x) for x in letters]] = c
    out[SEPARATOR] = END
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state by state and class, output likewise, products of the monoid, its elements as rows of states).

    Element c < N_CLASSES is the step of class c, so that classes are elements as they stand.
    """
    go = np.array([[_step(s, c)[0] for c in range(N_CLASSES)] for s in range(N_STATES)], np.uint8)
    out = np.array([[_step(s, c)[1] for c in range(N_CLASSES)] for s in range(N_STATES)], np.uint8)
    elements = [tuple(go[:, c]) for c in range(N_CLASSES)]
    known: dict[tuple, int] = {}
    for i, e in enumerate(elements):
        known.setdefault(e, i)
    at = 0
    while at < len(elements):  # closure under a further step
        for c in range(N_CLASSES):
            e = tuple(go[list(elements[at]), c])
            if e not in known:
                known[e] = len(elements)
                elements.append(e)
        at += 1
    rows = np.array(elements, np.uint8)
    products = np.array([[known[tuple(b[a])] for b in rows] for a in rows], np.uint16)
    return go, out, products, rows


def starts(points: np.ndarray) -> np.ndarray:
    """Positions in an array of code points at which a piece (or a separator) begins."""
    go, out, products, rows = automaton()
    n = len(points)
    n_blocks = -(-n // BLOCK)
    flat = np.full(n_blocks * BLOCK, END, np.uint8)
    flat[:n] = classes()[points]
    steps_by_block = np.ascontiguousarray(flat.reshape(n_blocks, BLOCK).T)
    m = len(rows)
    products = products.ravel()
    total = steps_by_block[0].astype(np.intp)
    for row in steps_by_block[1:]:
        total = products[total * m + row].astype(np.intp)
    shift = 1
    while shift < n_blocks:  # inclusive prefix products of the blocks, by doubling
        total[shift:] = products[total[:-shift] * m + total[shift:]]
        shift *= 2
    state = np.full(n_blocks, START, np.intp)
    state[1:] = rows[total[:-1], START]
    says = np.empty((BLOCK, n_blocks), np.uint8)
    go, out = go.ravel(), out.ravel()
    for k, row in enumerate(steps_by_block):
        cell = state * N_CLASSES + row
        says[k] = out[cell]
        state = go[cell].astype(np.intp)
    says = says.T.ravel()[:n]
    begins = (says & HERE).astype(bool)
    begins[:-1] |= (says[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces of all texts in order as UTF-8, the number of pieces in each text, and each piece's byte offset in its text."""
    joined = chr(0).join(texts) + chr(0)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    points[ends] = SEPARATOR
    at = starts(points)
    width = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    width[ends] = 1
    byte = np.concatenate(([0], np.cumsum(width)))
    keep = points[at] != SEPARATOR
    stop = byte[np.append(at[1:], len(points))]
    a, z = byte[at][keep], stop[keep]
    data = joined.encode("utf-8", "surrogatepass")
    doc = np.searchsorted(ends, at[keep])
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], byte[ends[:-1] + 1])) if len(texts) else np.zeros(0, np.int64)
    return [data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], counts, a - first[doc]


class Vocabulary:
    """Ranks of a byte-level BPE, with a cache of merged pieces of SHORT bytes at most.

    The cache has two halves of CACHE_BYTES each: what is not asked for while one half fills is forgotten.
    """

    CACHE_BYTES = 30_000_000
    ENTRY_BYTES = 170  # of two bytes objects and their place in a dictionary, beside what they hold
    SHORT = 100

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= self.SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """Looks for the lowest rank among all pairs after each merge."""
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """Keeps all pairs in a heap, by rank and place."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # ends[i]: where the part that begins at i stops
        previous = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (right := ends[i]) >= n or not alive[right] or ends[right] != stop:
                continue  # one of the two parts has been merged since
            alive[right] = 0
            ends[i] = stop
            if stop < n:
                previous[stop] = i
                if (r := ranks.get(piece[i : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, i, ends[stop]))
            if (left := previous[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def packed(self, found: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        long: dict[bytes, bytes] = {}
        for piece in set(found).difference(self.cache):
            if (data := self.old.get(piece)) is None:
                ids = self.merge(piece)
                data = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > self.SHORT:
                long[piece] = data
            else:
                self.cache[piece] = data
                self.held += len(piece) + len(data) + self.ENTRY_BYTES
        cache = self.cache
        out = [cache.get(p) or long[p] for p in found] if long else [cache[p] for p in found]
        if self.held > self.CACHE_BYTES:
            self.old, self.cache, self.held = self.cache, {}, 0
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def read_vocabulary(path: str | None = None) -> bytes:
    """The rank file, which is of a fixed size (under 1 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


#: Bytes of text of one step.
STEP = 400_000


def encode(texts: list[str | None], vocab: Vocabulary) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each text its packed ids, and of each piece the byte offset and the number of ids."""
    found, counts, offsets = pieces([t or "" for t in texts])
    packed = vocab.packed(found)
    n_ids = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    at = 0
    for n in counts.tolist():
        yield b"".join(packed[at : at + n]), offsets[at : at + n], n_ids[at : at + n]
        at += n


def decode_slice(ids: bytes, offsets: np.ndarray, n_ids: np.ndarray, vocab: Vocabulary, start: int, stop: int) -> bytes:
    """Bytes start to stop of a text, from only those pieces that hold them."""
    first = max(int(np.searchsorted(offsets, start, "right")) - 1, 0)
    last = int(np.searchsorted(offsets, stop, "left"))
    if first >= last:
        return b""
    skip = int(n_ids[:first].sum())
    data = vocab.decode(np.frombuffer(ids, "<u4")[skip : skip + int(n_ids[first:last].sum())])
    return data[start - int(offsets[first]) : stop - int(offsets[first])]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with columns token_ids (binary, little-endian unsigned 32-bit) and n_tokens; names that are taken get a leading ``_``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path)), docs.columns.index(text)
    ids = free_name(docs.columns, "token_ids")
    count = free_name([*docs.columns, ids], "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            for a, z, texts in slices(batch.column(at), STEP):
                packed = [x[0] for x in encode(texts, vocab)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, z - a).columns, pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())], names=[*batch.schema.names, ids, count])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())]))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, _, texts in slices(batch.column(1), STEP):
                for packed, _, _ in encode(texts, vocab):
                    n.append(len(packed) // 4)
                    of_ids.append(hashlib.sha256(packed).hexdigest())
                    of_bytes.append(hashlib.sha256(vocab.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
