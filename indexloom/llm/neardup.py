"""Operator 10, near-duplicates: BagMinHash signatures, banding, and verification of multiset overlap.

A text is the multiset of its five-word shingles. Each shingle has Poisson processes on dyadic intervals of weight,
(0,1], (1,2], (2,4], (4,8] and so on; a point of a process has a time, a component of the signature and a unit of
weight, and counts only where the shingle's multiplicity reaches that unit. Weights are whole numbers, so a point's unit
is drawn at once (an interval is not halved down to it), and points beyond the multiplicity, fewer than those within it,
are drawn and passed over. A
component of the signature is the earliest time of its points, so two texts agree in it with a probability that is
their weighted Jaccard similarity. Times are drawn only up to what a text needs to fill its signature.

Equal texts are one node. Nodes that agree in a whole band are candidates; in each band's bucket all nodes are compared
with the one that meets most others. When components are known, nodes that share a bucket with another component are
joined once more by an exact prefix filter across components, so that no pair that shares a band stays undecided, and
a group of near copies costs no pairs within it.
A pair is a link if the sum of minima of its multiplicities is at least 0.8 of the sum of maxima.

Defined results: words are maximal runs outside ASCII white space, as they stand; a text of one to four words is one
shingle; a null text or one without words is a class of its own row; the class of a group is its least doc_id (nulls
are passed over); repeated rows are one class; ties (copies that share their doc_id) are decided by their other columns;
texts of any length are read whole; an empty table gives an empty result; other columns, whatever their
names, pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, gathered, give_back, join_by_key, mix64, slices, split_words, table
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 40 bands of 6 components with a probability of 5e-6.
BANDS, ROWS = 40, 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of the text of each."""
    words, counts = split_words(texts)
    known = {w: xxhash.xxh64_intdigest(w) for w in dict.fromkeys(words)}
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    number = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[doc]
    length = np.minimum(counts, width)[doc]
    padded = np.concatenate([mix64(x), np.zeros(width, np.uint64)])
    h = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mix64(h * GOLDEN + np.where(k < length, padded[at + k], np.uint64(k)))
    return h, doc


def multisets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity) of all distinct shingles of each text, by text and shingle."""
    h, doc = shingles(texts, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, one row a text; rows of texts without shingles stay infinite."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # intervals that reach below the multiplicity
    of = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, width)
    doc, weight = doc[of], weight[of]
    total = np.bincount(doc, weights=width, minlength=n_docs)
    signature = np.full(n_docs * m, np.inf)
    with np.errstate(over="ignore", divide="ignore"):
        seed = mix64(h[of] + level.astype(np.uint64) * GOLDEN)
        limit = np.where(total > 0, (np.log(m) + 2) / total, 0)
        drawn = np.zeros(len(of), np.uint64)
        time = np.zeros(len(of))

        def advance(i: np.ndarray) -> None:
            drawn[i] += np.uint64(1)
            u = (mix64(seed[i] + drawn[i] * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            time[i] -= np.log1p(-u) / (m * width[i])

        live = np.arange(len(of))
        advance(live)
        while len(live):
            due = live[time[live] <= limit[doc[live]]]
            while len(due):
                r = mix64(seed[due] ^ mix64(drawn[due] + np.uint64(77)))
                unit = low[due] + 1 + (r & (width[due] - 1).astype(np.uint64)).astype(np.int64)
                hit = due[unit <= weight[due]]
                component = ((r[unit <= weight[due]] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(signature, doc[hit] * m + component, time[hit])
                advance(due)
                due = due[time[due] <= limit[doc[due]]]
            unfilled = np.isinf(signature.reshape(n_docs, m)).any(axis=1) & (total > 0)
            limit = limit * 1.5
            live = live[unfilled[doc[live]]]
    return signature.reshape(n_docs, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band; bands have keys of their own."""
    cells = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), cells.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix64(key * GOLDEN + cells[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, texts in slices(batch.column(1)):
            doc, h, weight = multisets(texts)
            keys = band_keys(bag_min_hash(doc, h, weight, z - a, bands * rows), bands, rows)
            some = np.flatnonzero(np.bincount(doc, minlength=z - a))
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(some)), lists], names=["node", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of minima and of maxima of two multisets, given as sorted shingles and multiplicities."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, h, weight = multisets([text])
    return h, weight


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    last = bag = None
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            if (u := batch.column(0)[i].as_py()) != last:
                last, bag = u, _bag(batch.column(2)[i].as_py())
            least, most = overlap(bag, _bag(batch.column(3)[i].as_py()))
            if least >= similarity * most:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["u", "v"])
        give_back()


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose multisets overlap enough. A pair's second text is joined first, so that a node that many others are compared with is read once a partition and not sent with each of them."""
    right = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(partial(_verify, similarity=similarity), "u binary, v binary")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k-th occurrence of a shingle is an element of its own, so that sets of elements overlap as multisets do."""
    for batch in batches:
        for a, z, texts in slices(batch.column(2)):
            doc, h, weight = multisets(texts)
            of = np.repeat(np.arange(len(h)), weight)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
            size = np.bincount(doc[of], minlength=z - a)
            at = pa.array(doc[of] + a)
            element = mix64(h[of] + mix64(nth.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size[doc[of]]), pa.array(element)], names=["node", "component", "size", "element"])


def _across(residual: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes of different components that may be links: an exact prefix filter, rarest elements first.

    Two sets of sizes a <= b that overlap enough share an element among the first a - ceil(2 s a / (1 + s)) + 1 of the
    smaller and the first b - ceil(s b) + 1 of the larger, in any common order. Elements that no second node has only
    count towards places, so a copy with many edits of its own has nothing to meet others by.
    """
    rows = residual.join(texts, "node").select("node", "component", "text").mapInArrow(_elements, "node binary, component binary, size bigint, element bigint")
    rows = cut(rows)
    shared = rows.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    w = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "element"))
    ranked = rows.join(shared, "element").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)
    ranked = cut(ranked.select("node", "component", "size", "element", "place"))
    a, b = ranked.alias("a"), ranked.alias("b")
    need = F.ceil(similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-9)
    met = (
        (F.col("a.element") == F.col("b.element"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node"))))
        & (F.col("a.size") >= similarity * F.col("b.size") - 1e-9)
        & (F.col("a.place") <= F.col("a.size") - F.ceil(2 * similarity / (1 + similarity) * F.col("a.size") - 1e-9) + 1)
        & (F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) + 1 >= need)
    )
    return cut(a.join(b, met).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct())


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def node_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, doc_id, component) for every different text with a word: its least doc_id, and the least node of its group."""
    own = _nodes(docs.select("doc_id", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = cut(own.select("node", "text").mapInArrow(partial(_sign, bands=bands, rows=rows), "node binary, bands array<bigint>"))
    n_rows = signed.count()
    n_keys = n_rows * bands
    first = cut(gathered(own.groupBy("node").agg(F.min("doc_id").alias("doc_id")), n_rows))
    keyed = signed.select("node", F.explode("bands").alias("band"))
    # copies of a text have equal bands: a bucket is crowded if it holds two different nodes
    crowded = keyed.groupBy("band").agg(F.min(F.xxhash64("node")).alias("lo"), F.max(F.xxhash64("node")).alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    crowded = cut(gathered(crowded.select("band", "n"), n_keys))
    n_met = crowded.agg(F.sum("n")).first()[0] or 0  # what follows has at most twice as many rows, until texts are joined
    met = cut(gathered(join_by_key(keyed, crowded, "band", n_keys).select("node", "band").distinct(), n_met))
    degree = join_by_key(met, met.groupBy("band").agg(F.count("*").alias("n")), "band", n_met).groupBy("node").agg(F.sum("n").alias("degree"))
    centre = gathered(met.join(degree, "node"), n_met).groupBy("band").agg(F.max(F.struct("degree", "node")).alias("c"), F.count("*").alias("n")).select("band", F.col("c.node").alias("u"), "n")
    centre = cut(gathered(centre, n_met))
    pairs = cut(gathered(join_by_key(met, centre, "band", n_met).where("node <> u").select("u", F.col("node").alias("v")).distinct(), n_met))
    paired = gathered(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), n_met)
    wanted = gathered(paired.join(first, "node"), n_rows + n_met).select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    texts = cut(own.join(wanted, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text").dropDuplicates(["node"]))
    links = gathered(cut(_links(pairs, texts, similarity)), n_met)
    found = cut(components(links))
    named = cut(gathered(met.join(found, "node", "left"), n_met).select("band", "node", F.coalesce("component", "node").alias("component")))
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    residual = gathered(join_by_key(named, split.select("band", "n"), "band", n_met).select("node", "component").distinct(), n_met)
    more = cut(_links(_across(residual, texts, similarity), texts, similarity))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    return first.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of every row of ``docs`` (columns doc_id, text)."""
    nodes = node_classes(docs, similarity, bands, rows)
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classes = nodes.join(least, "component").select("node", "class_id")
    members = _nodes(docs.select("doc_id", "text")).select("doc_id", "node", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    joined = members.join(classes, "node", "left")
    return joined.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, but of each group only one: the least doc_id. Rows without words all stay."""
    nodes = node_classes(docs, similarity, bands, rows)
    kept = nodes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select("k.node", "k.doc_id")
    rows = docs.select(F.struct("*").alias("row"))  # so that no name of docs can clash
    worded = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = rows.where(worded).withColumn("own", F.unhex(F.md5(F.col("row.text").cast("binary"))))
    one = own.join(kept, (F.col("own") == F.col("node")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    nth = F.row_number().over(Window.partitionBy("own", F.col("row.doc_id")).orderBy(F.to_json("row")))
    one = one.withColumn("nth", nth).where("nth = 1").select("row")
    return one.union(rows.where(~worded)).select("row.*")


def op10_bagminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
