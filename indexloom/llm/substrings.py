"""Operator 4, substring dedup: hashing of units of lines.

A text's lower-cased words are dealt into units: lines and sentences, where those of less than MIN_UNIT words are joined
to the next. Units are also cut wherever the hash of two neighbouring words says so (or else at MAX_UNIT words), so that
a passage holds whole units wherever its own ends fall, and lines of few words come back into step. Digests are grouped globally. The k-th occurrence of a digest in
a text is tied to the k-th one of the earliest text that has so many (or to the first occurrence, where that text is its
own), and each later one to the first one of its own text as well. Ties that follow on in both places are a chain. A chain is lengthened word by word at both ends against the words
around its earlier place, and is a passage if it then has ``min_words`` words. The earliest occurrence of a passage
stays, later ones are removed, and offsets stay those of the original.

Digests have 64 bits in the global grouping; a chain counts only if a second hash over all its words agrees as well.
Texts are ranked by doc_id, nulls last, and by the hash of the text where those are equal.

Defined results: a null or empty text has no units; rows that share doc_id and text (or have no doc_id and share the
text) are one text, of which none outranks another; a text that repeats with a period keeps its first one, or
a unit or two of it where the period is shorter than a unit; passages that overlap are
one, named after the earlier place of the one that starts first; texts of any length are read whole; an empty table
gives an empty result; other columns, whatever their names, pass through ``remove_passages`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, mix64, slices, table
from .shared import stored

MIN_WORDS = 50
#: Least words of a unit that ends with its line or sentence, and most of any.
MIN_UNIT, MAX_UNIT = 4, 20
#: A unit ends between two words, by their hash, with a chance of one in DIVISOR.
DIVISOR = 20
#: Words of a chain before it is lengthened; shorter ones are everyday phrases.
MIN_CHAIN = 8
BASE, PRIME = 1_000_003, 2_147_483_647
LAST = (1 << 63) - 1
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(MAX_UNIT)], np.uint64)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)


#: Digests of words that a worker has seen; begun anew at WORDS of them. Words above LONG bytes are not kept.
_DIGESTS: dict[bytes, bytes] = {}
WORDS, LONG = 1 << 17, 64


def _digest(word: bytes) -> bytes:
    """The first eight bytes of a word's MD5."""
    out = hashlib.md5(word, usedforsecurity=False).digest()[:8]
    if len(word) <= LONG:
        if len(_DIGESTS) >= WORDS:
            _DIGESTS.clear()
        _DIGESTS[word] = out
    return out


class Units:
    """The units of some texts: ``x`` has a hash for each word, units begin at words ``start`` and end before ``stop``."""

    def __init__(self, texts: list[str | None]):
        words: list[bytes] = []
        line_ends, ends = [], []
        for text in texts:
            for line in (text or "").lower().encode("utf-8", "surrogatepass").split(b"\n"):
                words += line.split()  # cuts at exactly WORD's gaps
                line_ends.append(len(words))
            ends.append(len(words))
        n = len(words)
        self.word_ends = np.asarray(ends, np.int64)
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(known.__getitem__, words), np.int64, n)
        digests = np.frombuffer(b"".join([_DIGESTS.get(w) or _digest(w) for w in known]), ">u8").astype(np.uint64)
        stops = np.isin(np.fromiter((w[-1] for w in known), np.uint8, len(known)), np.frombuffer(b".!?", np.uint8))
        self.x = digests[at]
        h = (self.x >> np.uint64(36)).astype(np.int64)
        may, must = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        if n:
            may[1:n] = stops[at[:-1]]
            must[1:n] = (h[:-1] * BASE + h[1:]) % PRIME % DIVISOR == 0
        # words on both sides of a text's end are cut apart by that end, so what their hash says changes nothing
        may[line_ends] = must[ends] = True
        cuts, last = [], 0
        places = np.flatnonzero(may | must)
        for c, sure in zip(places.tolist(), must[places].tolist(), strict=True):
            while c - last > MAX_UNIT:
                last += MAX_UNIT
                cuts.append(last)
            if c > last and (sure or c - last >= MIN_UNIT):
                cuts.append(c)
                last = c
        self.stop = np.asarray(cuts, np.int64)
        self.start = np.concatenate(([0], self.stop[:-1])) if cuts else self.stop
        self.text = np.searchsorted(self.word_ends, self.start, "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts)))  # each text's first unit

    def digests(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.stop - self.start
        place = np.arange(len(self.x)) - np.repeat(self.start, size)
        with np.errstate(over="ignore"):
            return mix64(np.add.reduceat(self.x * _POWERS[place], self.start) + size.astype(np.uint64))

    def second_hash(self, a: int, z: int) -> int:
        """Another hash of words a to z, as a signed integer."""
        with np.errstate(over="ignore"):
            place = mix64(np.arange(z - a, dtype=np.uint64))
            return int(mix64((mix64(self.x[a:z] ^ _AGAIN) * (place | np.uint64(1))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])

    def words_of(self, text: int, nth: int, n: int) -> tuple[int, int, int, int]:
        """(first word, last word + 1) of ``n`` units from the ``nth`` one of a text, and those of the whole text."""
        i = self.first[text] + nth
        return int(self.start[i]), int(self.stop[i + n - 1]), int(self.word_ends[text - 1]) if text else 0, int(self.word_ends[text])


def text_hash(text: str | None) -> int:
    """As Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed=42)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit; ``again`` is a second row, as if it were the first occurrence, for each later one."""
    for batch in batches:
        for a, _, texts in slices(batch.column(1)):
            u = Units(texts)
            digest = u.digests()
            order = np.lexsort((digest, u.text))
            new = np.ones(len(order), bool)
            new[1:] = (digest[order[1:]] != digest[order[:-1]]) | (u.text[order[1:]] != u.text[order[:-1]])
            k = np.zeros(len(order), np.int32)
            k[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            own = np.array([text_hash(t) for t in texts], np.uint64).view(np.int64)
            rows = np.concatenate((np.arange(len(digest)), np.flatnonzero(k)))
            again = np.arange(len(rows)) >= len(digest)
            of = u.text[rows]
            earliest = np.zeros(len(order), np.int64)  # the first unit of a text that has a unit's digest
            earliest[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] - u.first[u.text[order]]
            columns = [digest.view(np.int64)[rows], np.where(again, 0, k[rows]).astype(np.int32), own[of], (rows - u.first[of]).astype(np.int32), (u.stop - u.start)[rows].astype(np.int32), again]
            columns = [batch.column(0).take(pa.array(of + a)), *map(pa.array, columns), pa.array(np.where(again, -1, earliest[rows]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "k", "own", "nth", "words", "again", "earliest"])


def _around(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """For each wanted chain its number of words, their second hash, and the 32-bit hashes of up to ``reach`` words before (nearest first) and after."""
    schema = pa.schema([("a_doc", pa.int64()), ("a_own", pa.int64()), ("a_nth", pa.int32()), ("n", pa.int32()), ("n_words", pa.int32()), ("check", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
    for batch in batches:
        for a, _, texts in slices(batch.column(2)):
            u, out = Units(texts), []
            short = (u.x >> np.uint64(32)).astype("<u4")
            for i in range(len(texts)):
                for want in batch.column(3)[a + i].as_py():
                    lo, hi, first, last = u.words_of(i, want["a_nth"], want["n"])
                    out.append((batch.column(0)[a + i].as_py(), batch.column(1)[a + i].as_py(), want["a_nth"], want["n"], hi - lo, u.second_hash(lo, hi), short[max(lo - reach, first) : lo][::-1].tobytes(), short[hi : min(hi + reach, last)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 8, schema, strict=True)], schema=schema)


def _agree(a: np.ndarray, b: bytes) -> int:
    """How many values agree from the first on."""
    other = np.frombuffer(b, "<u4")
    n = min(len(a), len(other))
    if not n or a[0] != other[0]:
        return 0
    differ = a[:n] != other[:n]
    at = int(differ.argmax())
    return at if differ[at] else n


def _lengthen(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The passages of each text, from its chains."""
    reach = min_words - 1
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int64()), ("kept_doc_id", pa.int64())])
    for batch in batches:
        for a, _, texts in slices(batch.column(2)):
            u, out = Units(texts), []
            short = (u.x >> np.uint64(32)).astype("<u4")
            for i, text in enumerate(texts):
                found = []
                for c in batch.column(3)[a + i].as_py():
                    lo, hi, first, last = u.words_of(i, c["nth"], c["n"])
                    if hi - lo != c["n_words"]:
                        continue
                    left = _agree(short[max(lo - reach, first) : lo][::-1], c["before"])
                    right = _agree(short[hi : min(hi + reach, last)], c["after"])
                    # most chains are everyday phrases and too short; only the others are worth their second hash
                    if hi - lo + left + right >= min_words and u.second_hash(lo, hi) == c["check"]:
                        found.append((lo - left - first, c["a_doc"], hi + right - first))
                if not found:
                    continue
                merged: list[list[int]] = []
                for start, kept, stop in sorted(found):
                    if merged and start < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], stop)
                    else:
                        merged.append([start, kept, stop])
                begins = [m.start() for m in re.finditer(WORD, text)]
                for start, kept, stop in merged:  # a passage takes the gap behind it along
                    out.append((batch.column(0)[a + i].as_py(), batch.column(1)[a + i].as_py(), begins[start] if start else 0, begins[stop] if stop < len(begins) else len(text), stop - start, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)


def _chains(texts: DataFrame) -> DataFrame:
    """Chains of ties: ``n`` units from ``nth`` on of a text (doc_id, own) stand from ``a_nth`` on in an earlier one (a_doc, a_own)."""
    found = stored(texts.select("doc_id", "text").mapInArrow(_units, "doc_id bigint, digest bigint, k int, own bigint, nth int, words int, again boolean, earliest int"), "units")  # read twice; cutting costs more than reading
    place = F.struct("doc_id", "own", "nth")
    first = found.where("NOT again").groupBy("digest", "k").agg(F.min(place).alias("f"), F.max(F.struct("doc_id", "own")).alias("last"))
    # written first, so that both sides of the join are shuffled for it, and a frequent digest can be split
    first = cut(first.where(F.struct("f.doc_id", "f.own") < F.col("last")).select("digest", "k", F.col("f.doc_id").alias("a_doc"), F.col("f.own").alias("a_own"), F.col("f.nth").alias("a_nth")))
    joined = found.join(first, ["digest", "k"], "left")
    other = F.when(F.struct("a_doc", "a_own") < F.struct("doc_id", "own"), F.struct("a_doc", "a_own", "a_nth"))
    same = F.when((F.col("earliest") >= 0) & (F.col("earliest") < F.col("nth")), F.struct(F.col("doc_id").alias("a_doc"), F.col("own").alias("a_own"), F.col("earliest").alias("a_nth")))
    places = F.explode(F.array_compact(F.array(other, same))).alias("a")
    ties = joined.select("doc_id", "own", "nth", "words", places).select("doc_id", "own", "nth", "words", "a.*").withColumn("delta", F.col("a_nth") - F.col("nth"))
    one = ["doc_id", "own", "a_doc", "a_own", "delta"]
    run = F.col("nth") - F.dense_rank().over(Window.partitionBy(*one).orderBy("nth"))  # rows that repeat have one rank
    n = F.max("nth") - F.min("nth") + 1
    runs = ties.withColumn("run", run).groupBy(*one, "run").agg(F.min("nth").alias("nth"), n.alias("n"), (F.sum("words") * n / F.count("*")).alias("words"))
    return cut(runs.where(F.col("words") >= MIN_CHAIN).select("doc_id", "own", "nth", "n", "a_doc", "a_own", (F.col("nth") + F.col("delta")).alias("a_nth")))


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, own, start, stop, n_words, kept_doc_id); own is a hash of the text."""
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("own"), "text")
    chains = _chains(texts)
    wanted = chains.groupBy("a_doc", "a_own").agg(F.collect_set(F.struct("a_nth", "n")).alias("wanted"))
    earlier = keyed.select(F.col("doc_id").alias("a_doc"), F.col("own").alias("a_own"), "text").join(wanted, ["a_doc", "a_own"])
    around = cut(earlier.mapInArrow(partial(_around, reach=min_words - 1), "a_doc bigint, a_own bigint, a_nth int, n int, n_words int, check bigint, before binary, after binary").distinct())
    met = chains.join(around, ["a_doc", "a_own", "a_nth", "n"])
    by_text = met.groupBy("doc_id", "own").agg(F.collect_list(F.struct("nth", "n", "n_words", "check", "before", "after", "a_doc")).alias("chains"))
    later = keyed.join(by_text, ["doc_id", "own"]).select("doc_id", "own", "text", "chains")
    return later.mapInArrow(partial(_lengthen, min_words=min_words), "doc_id bigint, own bigint, start int, stop int, n_words bigint, kept_doc_id bigint").distinct()


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, stop, n_words, kept_doc_id) of every passage to remove; kept_doc_id has it before."""
    return _passages(docs, min_words).select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "start", "stop", "n_words", F.nullif("kept_doc_id", F.lit(LAST)).alias("kept_doc_id"))


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the passages cut out of text, and a column kept_spans (with a leading ``_`` if the name is taken) of the (start, stop) that are left of the original."""
    cuts = _passages(docs, min_words).groupBy("doc_id", "own").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    text = F.col("row.text")
    same = (F.coalesce(F.col("row.doc_id"), F.lit(LAST)) == F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("own"))
    joined = docs.select(F.struct("*").alias("row")).join(cuts, same, "left")  # a struct, so that no name of docs can clash
    size = F.length(text)
    edge = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))
    end = F.struct(size.alias("start"), size.alias("stop"))
    marks = F.concat(F.array(edge), F.coalesce("cuts", F.array().cast("array<struct<start:int,stop:int>>")), F.array(end))
    gaps = F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1), lambda a, b: F.struct(a["stop"].alias("start"), b["start"].alias("stop")))
    kept = F.when(text.isNotNull(), F.filter(gaps, lambda g: g["start"] < g["stop"]))
    left = F.concat_ws("", F.transform("kept", lambda g: F.substring(text, g["start"] + 1, g["stop"] - g["start"])))
    out = joined.select("row", "cuts", kept.alias("kept"))
    name = free_name(docs.columns, "kept_spans")
    return out.select(F.col("row").withField("text", F.when(F.col("cuts").isNull(), text).otherwise(left)).alias("row"), F.col("kept").alias(name)).select("row.*", name)


def op4_line_hash_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
lw AS (SELECT doc_id, i, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM l),
lu AS (SELECT doc_id, i, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM lw),
w AS (
  SELECT doc_id, word, j = 1 AS starts, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS p, ('0x' || substr(md5(word), 1, 7))::BIGINT AS h FROM lu),
c AS (
  SELECT doc_id, p, word, p > 0 AND (starts OR right(lag(word) OVER o, 1) IN ('.', '!', '?')) AS may, p > 0 AND (lag(h) OVER o * 1000003 + h) % 2147483647 % 20 = 0 AS must
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT doc_id, max(p) + 1 AS n, coalesce(list([p, must::BIGINT] ORDER BY p) FILTER (WHERE may OR must), []) AS places FROM c GROUP BY doc_id),
g AS (
  SELECT doc_id, list_reduce(list_prepend([0::BIGINT], list_append(places, [n, 1])), lambda a, b:
    list_concat(list_concat(a, list_transform(generate_series(1, greatest((b[1] - a[-1] - 1) // 20, 0)), lambda x: a[-1] + 20 * x)),
      CASE WHEN b[2] = 1 OR b[1] - a[-1] - 20 * greatest((b[1] - a[-1] - 1) // 20, 0) >= 4 THEN b[1:1] ELSE [] END)) AS cuts
  FROM n),
u AS (
  SELECT doc_id, nth - 1 AS nth, cuts[nth] AS a, cuts[nth + 1] AS z FROM (SELECT doc_id, cuts, unnest(generate_series(1, len(cuts) - 1)) AS nth FROM g)),
d AS (
  SELECT u.doc_id, u.nth, u.a, u.z, string_agg(c.word, ' ' ORDER BY c.p) AS digest FROM c ASOF JOIN u ON c.doc_id = u.doc_id AND c.p >= u.a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY nth) - 1 AS k FROM d),
f AS (SELECT digest, k, arg_min(doc_id, doc_id) AS a_doc, arg_min(nth, doc_id) AS a_nth FROM k GROUP BY digest, k),
s AS (
  SELECT DISTINCT k.doc_id, k.nth, z - a AS words, a_doc, a_nth FROM k JOIN f ON k.digest = f.digest AND (f.k = k.k OR f.k = 0) WHERE a_doc < doc_id
  UNION SELECT l.doc_id, l.nth, l.z - l.a, e.doc_id, e.nth FROM k l JOIN k e ON e.doc_id = l.doc_id AND e.digest = l.digest AND e.k = 0 WHERE l.k > 0),
r AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, a_doc, a_nth - nth ORDER BY nth) AS run FROM s),
h AS (
  SELECT doc_id, a_doc, min(nth) AS lo, max(nth) AS hi, min(a_nth) AS a_lo, max(a_nth) AS a_hi FROM r GROUP BY doc_id, a_doc, a_nth - nth, run HAVING sum(words) >= 8),
e AS (
  SELECT row_number() OVER () AS id, h.doc_id, h.a_doc, x.a, y.z, v.a AS b, q.z AS y FROM h JOIN u x ON x.doc_id = h.doc_id AND x.nth = lo JOIN u y ON y.doc_id = h.doc_id AND y.nth = hi
  JOIN u v ON v.doc_id = h.a_doc AND v.nth = a_lo JOIN u q ON q.doc_id = h.a_doc AND q.nth = a_hi),
steps AS (SELECT *, unnest(generate_series(1, 49)) AS j FROM e),
agree AS (
  SELECT s.id, coalesce(min(j) FILTER (WHERE l1.word IS NULL OR l2.word IS NULL OR l1.word <> l2.word), 50) - 1 AS l, coalesce(min(j) FILTER (WHERE r1.word IS NULL OR r2.word IS NULL OR r1.word <> r2.word), 50) - 1 AS r
  FROM steps s LEFT JOIN w l1 ON l1.doc_id = s.doc_id AND l1.p = a - j LEFT JOIN w l2 ON l2.doc_id = s.a_doc AND l2.p = b - j
  LEFT JOIN w r1 ON r1.doc_id = s.doc_id AND r1.p = z + j - 1 LEFT JOIN w r2 ON r2.doc_id = s.a_doc AND r2.p = y + j - 1 GROUP BY s.id),
p AS (SELECT doc_id, a_doc, a - l AS a, z + r AS z FROM e JOIN agree USING (id) WHERE z - a + l + r >= 50),
m AS (SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, a_doc, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM p),
i AS (SELECT *, sum((a >= reach)::INTEGER) OVER (PARTITION BY doc_id ORDER BY a, a_doc, z ROWS UNBOUNDED PRECEDING) AS run FROM m),
x AS (SELECT doc_id, min(a) AS a, max(z) AS z, arg_min(a_doc, {'a': a, 'd': a_doc, 'z': z}) AS kept_doc_id FROM i GROUP BY doc_id, run),
tokens AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS p FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ts FROM t)),
begins AS (
  SELECT doc_id, p, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY p) - length(regexp_extract(token, '[^\x20\x09-\x0D]+')) AS at FROM tokens)
SELECT x.doc_id, CASE WHEN a = 0 THEN 0 ELSE b.at END::INTEGER AS start, coalesce(s.at, length(t.text))::INTEGER AS stop, (z - a)::BIGINT AS n_words, kept_doc_id
FROM x JOIN t ON t.doc_id = x.doc_id JOIN begins b ON b.doc_id = x.doc_id AND b.p = a LEFT JOIN begins s ON s.doc_id = x.doc_id AND s.p = z
"""
