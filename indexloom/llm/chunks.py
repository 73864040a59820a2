"""Operator 5, line dedup by content-defined chunks of lines (DataFrame functions only).

A polynomial rolling hash over the hashes of a line and the one before decides whether a chunk may begin at the line; it
does unless one may begin at the line before as well, so boundaries depend on nearby lines alone and come back into step
after lines are put in or taken out. No chunk begins at a text's second or last line either: chunks have two lines or
more, and copies of a text of several lines go whole. Chunks whose hash occurs twice in the table are compared byte by
byte; of equal chunks the first one, by doc_id and place, stays and the others are removed. Texts of one line are never
touched.

Defined results: a null or empty text has no chunk to remove; a null doc_id ranks last; rows that share doc_id and text
are copies of which none outranks another; lines are what ``\\n`` separates, compared as they stand; texts of any length
are read whole; an empty table gives an empty result; other columns, whatever their names, pass through
``drop_repeated_chunks`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: A chunk may begin at a line with a chance of one in DIVISOR; with two, one in four lines begins a chunk, which is the most.
DIVISOR = 2
MIN_LINES = 2
BASE, PRIME = 1_000_003, 2_147_483_647
LAST = (1 << 63) - 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """The chunks of a text, in order; joined by line feeds they are the text again.

    Each line gets a letter in front, b where a chunk begins and c elsewhere, so that the joined lines split into chunks
    at line feeds that a b follows, whatever the lines hold. All of it is linear in the text.
    """
    lines = F.split(text, "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(x.alias("line"), _line_hash(x).alias("h")))
    none = lambda n: F.array_repeat(F.lit(None).cast("struct<line:string,h:bigint>"), n)
    may = lambda a, b: (a["h"] * BASE + b["h"]) % PRIME % divisor == 0

    def mark(known: Column) -> Column:
        around = F.arrays_zip(known.alias("own"), F.concat(none(1), known).alias("last"), F.concat(none(2), known).alias("before"), F.slice(known, 2, F.size(known)).alias("next"))
        begins = lambda e: e["before"].isNotNull() & e["next"].isNotNull() & may(e["last"], e["own"]) & ~may(e["before"], e["last"])
        return F.transform(F.filter(around, lambda e: e["own"].isNotNull()), lambda e: F.concat(F.when(begins(e), "b").otherwise("c"), e["own"]["line"]))

    marked = F.element_at(F.transform(F.array(hashed), mark), 1)  # so that each line is hashed once
    whole = F.array_join(marked, "\n")
    return F.transform(F.split(F.substring(whole, 2, LAST >> 32), "\nb", -1), lambda c: F.replace(c, F.lit("\nc"), F.lit("\n")))


def _n_lines(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def _repeats(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """(rank, own, nth, chunk, kept) of every chunk to remove; rank is doc_id with nulls last, own tells texts apart."""
    rows = docs.where(F.col("text").contains("\n")).select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("rank"), F.md5(F.col("text").cast("binary")).alias("own"), F.posexplode(chunks(F.col("text"), divisor)).alias("nth", "chunk"))
    rows = rows.where(_n_lines(F.col("chunk")) >= min_lines).withColumn("hash", F.xxhash64("chunk"))
    # what is joined is written first, so that both sides are shuffled for the join and a frequent chunk can be split
    often = cut(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    suspects = cut(rows.join(often, "hash"))
    first = suspects.groupBy("hash", "chunk").agg(F.min(F.struct("rank", "own", "nth")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select(F.col("hash").alias("of"), F.col("chunk").alias("bytes"), "kept"))
    equal = suspects.join(first, (F.col("hash") == F.col("of")) & (F.col("chunk") == F.col("bytes")))  # the byte comparison
    return equal.where(F.struct("rank", "own", "nth") > F.col("kept")).select("rank", "own", "nth", "chunk", "kept").distinct()


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, nth, n_lines, n_chars, chunk_md5, kept_doc_id, kept_nth) of every chunk to remove."""
    out = _repeats(docs, divisor, min_lines)
    shown = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return out.select(shown("rank").alias("doc_id"), "nth", _n_lines(F.col("chunk")).alias("n_lines"), F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), shown("kept.rank").alias("kept_doc_id"), F.col("kept.nth").alias("kept_nth"))


def drop_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with repeated chunks cut out of text; a row whose text had a word and has none left is dropped."""
    cuts = _repeats(docs, divisor, min_lines).groupBy("rank", "own").agg(F.collect_set("nth").alias("cuts"))
    text = F.col("row.text")
    same = (F.coalesce(F.col("row.doc_id"), F.lit(LAST)) == F.col("rank")) & (F.md5(text.cast("binary")) == F.col("own"))
    rows = docs.select(F.struct("*").alias("row")).join(cuts, same, "left")  # a struct, so that no name of docs can clash
    left = F.array_join(F.filter(chunks(text, divisor), lambda c, i: ~F.array_contains(F.col("cuts"), i)), "\n")
    worded = lambda c: F.coalesce(c.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = F.when(F.col("cuts").isNull(), text).otherwise(left)
    out = rows.select(F.col("row").withField("text", kept).alias("row"), (F.col("cuts").isNotNull() & worded(text)).alias("had"))
    return out.where(~F.col("had") | worded(F.col("row.text"))).select("row.*")


def op5_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_chunks(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, md5(text) AS own, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, chr(10))),
e AS (
  SELECT doc_id, own, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM l),
h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS lh FROM e),
b AS (
  SELECT *, coalesce((lag(lh) OVER w * 1000003 + lh) % 2147483647 % 2 = 0 AND (lag(lh, 2) OVER w * 1000003 + lag(lh) OVER w) % 2147483647 % 2 <> 0 AND lead(lh) OVER w IS NOT NULL, false)::INTEGER AS begins
  FROM h WINDOW w AS (PARTITION BY doc_id, own ORDER BY i)),
n AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id, own ORDER BY i) AS nth FROM b),
c AS (
  SELECT doc_id, own, nth::INTEGER AS nth, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*)::INTEGER AS n_lines
  FROM n GROUP BY doc_id, own, n.nth HAVING count(*) >= 2),
f AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(nth) OVER w AS kept_nth, row_number() OVER w AS r
  FROM c WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, own, nth))
SELECT doc_id, nth, n_lines, length(chunk)::INTEGER AS n_chars, md5(chunk) AS chunk_md5, kept_doc_id, kept_nth FROM f WHERE r > 1
"""
