"""Operator 12, hard negatives by a pivot table: rows whose score with an anchor lies in a band below a positive's score.

Entries become integers, so scores (inner products) are exact. With a further coordinate sqrt(M - |x|**2), M being the
greatest square of a norm, all rows have one norm, and an anchor q with 0 there has the distance d with
d**2 = |q|**2 + M - 2 * score. The pivot table holds each row's distances to PIVOTS pivots, which are spread over a sample of
SAMPLE rows; by the triangle inequality the differences and sums of two rows' pivot distances bracket their distance, and so
their score. Only rows whose bracket reaches into a band, and above the worst of the best rows so far, are multiplied out.

The table is written sorted by label, nearest pivot and distance to it, and BLOCK neighbouring rows make a block; anchors make
groups likewise. A block goes to a group only if the brackets of their ranges allow it. A group's blocks are dealt to lanes,
the tasks' units, as many as there are shuffle partitions to fill; a lane holds one group and one block at a time, blocks
with the best bracket first. What lanes find (a few rows an anchor) is ranked by windows. First come the positives
from blocks of an anchor's label, then the negatives from blocks of other labels.

Defined results: rows with a null label or vector, or a null, NaN or infinite entry, take no part, nor do vectors with another
number of entries than most (the larger number on a tie) or with entries so large that a score might not fit a long; rows of
no entries score 0; a null vec_id is no anchor, ranks last among ties and keeps its label; rows that repeat are each a
positive or negative of others, but one anchor, and no row is a positive of an anchor of its own vec_id; ties go to the
smaller vec_id; further columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, record_batch, shuffle_partitions, table
from .vectors import finite, matrix, pack, unpack, usual_length

SCALE = 256
ANCHOR_EVERY, LABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10

#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90

PIVOTS, SAMPLE = 8, 1024

#: The rows of a block are 2**BLOCK_BITS.
BLOCK_BITS = 11

#: The id of rows without one: the last among ties.
NO_ID = (1 << 63) - 1

Found = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def prepared(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of rows that take part, and the number of dimensions."""
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).alias("vector")).where("label IS NOT NULL")
    valid = own.where(finite(F.col("vector")))
    dims = usual_length(valid, "vector")
    largest = math.sqrt((1 << 61) / max(dims, 1)) / SCALE
    valid = valid.where((F.size("vector") == dims) & finite(F.col("vector"), largest))
    moved = F.when(F.col("vec_id") % LABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return valid.withColumn("label", moved), dims


def integers(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(matrix(column, dims) * SCALE).astype(np.int64)


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    """Rows with the coordinate that gives all of them the norm sqrt(most)."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))])


def spread_pivots(x: np.ndarray) -> np.ndarray:
    """Up to PIVOTS rows, each the farthest from those before it; the origin where there are no rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    chosen = [0]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.column_stack([((x - p) ** 2).sum(1) for p in pivots]))


class Pivots:
    """Pivots of a table, chosen on a sample, and the greatest square of a norm of the whole table."""

    def __init__(self, rows: DataFrame, dims: int):
        x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
        self.dims = dims
        self.most = int(rows.agg(F.max(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c))).first()[0] or 0) + 1
        sample = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).toArrow()
        values = np.floor(np.array(sample.column(0).to_pylist(), float).reshape(sample.num_rows, dims) * SCALE)
        self.points = spread_pivots(augmented(values, self.most))

    def table(self, rows: DataFrame, anchors: bool = False) -> DataFrame:
        """The pivot table of ``rows``, written once in its order; an anchor's further coordinate is 0."""
        dims, most, points = self.dims, self.most, self.points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = integers(batch.column(2), dims)
                full = np.column_stack([x.astype(float), np.zeros(len(x))]) if anchors else augmented(x, most)
                d = distances(full, points)
                near, norms = d.argmin(1), np.sqrt((x.astype(float) ** 2).sum(1))
                yield record_batch({"vec_id": (batch.column(0), pa.int64()), "label": (batch.column(1), pa.int64()), "x": ([pack(r) for r in x], pa.binary()), "norm": (norms, pa.float64()), "distances": (list(d), pa.list_(pa.float64())), "near": (near, pa.int32()), "near_distance": (d[np.arange(len(d)), near], pa.float64())})

        keys = ["label", "near", "near_distance", "vec_id"]
        found = rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id bigint, label bigint, x binary, norm double, distances array<double>, near int, near_distance double")
        ranged = found.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        numbered = ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.shiftright("row", BLOCK_BITS))
        return cut(numbered.select("row", "block", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "x", "norm", "distances"))

    def ranges(self, table: DataFrame, lead: str = "", *more: Column) -> DataFrame:
        """The ranges of labels, norms and pivot distances of each block."""
        ends = lambda f: F.array(*[f(F.col("distances")[i]) for i in range(len(self.points))])
        values = {"label_from": F.min("label"), "label_to": F.max("label"), "norm_from": F.min("norm"), "norm_to": F.max("norm"), "from": ends(F.min), "to": ends(F.max)}
        return table.groupBy(F.col("block").alias(f"{lead}block")).agg(*[v.alias(f"{lead}{k}") for k, v in values.items()], *more)


def scores(block: dict, keep: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of some rows of a block with an anchor: as doubles where these are exact, else as integers."""
    if "most" not in block:
        block["most"], block["real"] = int(np.abs(block["x"]).max(initial=0)), block["x"].astype(float)
    if block["most"] * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
        return (block["real"][keep] @ anchor.astype(float)).astype(np.int64)
    return block["x"][keep] @ anchor


def bracket(block: dict, q: np.ndarray, norm2: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of a block's rows with an anchor whose pivot distances are ``q``, rounding allowed for."""
    near = np.abs(block["distances"] - q).max(1)
    far = (block["distances"] + q).min(1)
    slack = 1e-9 * (norm2 + most) + 1
    return (norm2 + most - far * far) / 2 - slack, (norm2 + most - near * near) / 2 + slack


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` rows by falling score and rising id."""
    if len(score) > 4 * k:  # a row below the k-th score is not among them
        at = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[at], ids[at]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _merged(found: Found, key: tuple[int, int], score: np.ndarray, ids: np.ndarray, k: int) -> None:
    if key in found:
        score, ids = np.concatenate([found[key][0], score]), np.concatenate([found[key][1], ids])
    found[key] = best(score, ids, k)


def nearest(group: dict, block: dict, found: Found, most: int) -> None:
    """Merges a block's rows of an anchor's label into its best POSITIVES."""
    for a in range(len(group["ids"])):
        own = (block["labels"] == group["labels"][a]) & (block["ids"] != group["ids"][a])
        held = found.get((a, 0))
        if held is not None and len(held[0]) == POSITIVES:
            own &= bracket(block, group["distances"][a], group["norms"][a] ** 2, most)[1] >= held[0][-1]
        keep = np.flatnonzero(own)
        if len(keep):
            _merged(found, (a, 0), scores(block, keep, group["x"][a]), block["ids"][keep], POSITIVES)


def banded(group: dict, block: dict, found: Found, most: int) -> None:
    """Merges a block's rows of other labels into the best NEGATIVES of each positive in whose band they lie."""
    for a, wanted in enumerate(group["positives"]):
        if not wanted:
            continue
        floors = {}
        for w in wanted:
            held = found.get((a, w["p"]))
            floors[w["p"]] = max(-(-LOW * w["score"] // 100), int(held[0][-1]) if held is not None and len(held[0]) == NEGATIVES else -NO_ID)
        tops = {w["p"]: HIGH * w["score"] // 100 for w in wanted}
        lower, upper = bracket(block, group["distances"][a], group["norms"][a] ** 2, most)
        keep = np.flatnonzero((block["labels"] != group["labels"][a]) & (upper >= min(floors.values())) & (lower <= max(tops.values())))
        if not len(keep):
            continue
        score, ids = scores(block, keep, group["x"][a]), block["ids"][keep]
        for p, top in tops.items():
            inside = (score >= floors[p]) & (score <= top)
            if inside.any():
                _merged(found, (a, p), score[inside], ids[inside], NEGATIVES)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of runs of rows with equal first four columns."""
    key, held = None, []
    for batch in batches:
        keys = np.column_stack([np.asarray(c) for c in batch.columns[:4]])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if (own := tuple(keys[a].tolist())) != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = own, []
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def search(anchors: DataFrame, table: DataFrame, pairs: DataFrame, pivots: Pivots, kernel: Callable[[dict, dict, Found, int], None]) -> DataFrame:
    """(anchor, p, score, id): what ``kernel`` finds for each anchor's row in the blocks that ``pairs`` (group, block, high) allow."""
    spark = table.sparkSession
    groups = anchors.agg(F.count_distinct("block")).first()[0]
    lanes = -(-4 * shuffle_partitions(spark) // max(groups, 1))
    dims, most, points = pivots.dims, pivots.most, len(pivots.points)
    schema = "array<struct<p:int,score:bigint>>"
    wanted = F.col("positives") if "positives" in anchors.columns else F.lit(None).cast(schema)
    same = ["row", "vec_id", "label", "x", "norm", "distances"]
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    of_blocks = table.join(pairs, "block").select("group", lane, F.lit(1).alias("kind"), "block", *same, F.lit(None).cast(schema).alias("positives"), (-F.col("high")).alias("rank"))
    of_anchors = anchors.select(F.col("block").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), "block", *same, wanted.alias("positives"), F.lit(0.0).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict = {}
        found: Found = {}

        def out() -> pa.RecordBatch:
            rows = [(group["rows"][a], p, *pair) for (a, p), held in found.items() for pair in zip(*held, strict=True)]
            return record_batch({n: (v, t) for n, v, t in zip(("anchor", "p", "score", "id"), zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

        for key, unit in _units(batches):
            n = unit.num_rows
            x = np.vstack([unpack(v, 1, dims) for v in unit["x"].to_pylist()])
            own = {"rows": np.asarray(unit["row"]), "ids": np.asarray(unit["vec_id"]), "labels": np.asarray(unit["label"]), "norms": np.asarray(unit["norm"]), "x": x, "distances": unit["distances"].combine_chunks().flatten().to_numpy().reshape(n, points)}
            if key[2]:
                kernel(group, own, found, most)
            else:
                if found:
                    yield out()
                group, found = own | {"positives": unit["positives"].to_pylist()}, {}
        if found:
            yield out()

    both = of_blocks.unionByName(of_anchors).repartition("group", "lane").sortWithinPartitions("group", "lane", "kind", "rank", "block")
    return both.drop("rank").mapInArrow(run, "anchor bigint, p int, score bigint, id bigint")


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    valid, dims = prepared(rows, vector)
    pivots = Pivots(valid, dims)
    table = pivots.table(valid)
    anchors = pivots.table(valid.where(F.col("vec_id") % ANCHOR_EVERY == 0).dropDuplicates(["vec_id", "label", "vector"]), anchors=True)
    spans = pivots.ranges(table)
    gap = F.array_max(F.zip_with("from", "g_to", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    gap = F.greatest(gap, F.array_max(F.zip_with("g_from", "to", lambda a, b: F.greatest(a - b, F.lit(0.0)))))
    reach = F.array_min(F.zip_with("to", "g_to", lambda a, b: a + b))
    slack = 1e-9 * (F.col("g_norm_to") ** 2 + pivots.most) + 1
    high = (F.col("g_norm_to") ** 2 + pivots.most - gap * gap) / 2 + slack
    low = (F.col("g_norm_from") ** 2 + pivots.most - reach * reach) / 2 - slack

    meet = (F.col("label_from") <= F.col("g_label_to")) & (F.col("g_label_from") <= F.col("label_to"))
    # blocks against groups of the stated anchors, by their ranges: one row a block and group
    pairs = spans.join(pivots.ranges(anchors, "g_"), meet).select(F.col("g_block").alias("group"), "block", high.alias("high"))
    positives = cut(ranked(search(anchors, table, pairs, pivots, nearest), ["anchor"], POSITIVES).select("anchor", F.col("rank").alias("p"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))

    useful = positives.where("positive_score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("p", F.col("positive_score").alias("score")))).alias("positives"))  # at most POSITIVES
    seeking = anchors.join(useful.withColumnRenamed("anchor", "row"), "row")
    bands = [F.min(F.array_min("positives.score") * (LOW / 100)).alias("g_least"), F.max(F.array_max("positives.score") * (HIGH / 100)).alias("g_greatest")]
    other = ~((F.col("label_from") == F.col("label_to")) & (F.col("g_label_from") == F.col("g_label_to")) & (F.col("label_from") == F.col("g_label_from")))
    reachable = spans.join(pivots.ranges(seeking, "g_", *bands), other & (high >= F.col("g_least")) & (low <= F.col("g_greatest")))
    negatives = ranked(search(seeking, table, reachable.select(F.col("g_block").alias("group"), "block", high.alias("high")), pivots, banded), ["anchor", "p"], NEGATIVES)

    out = negatives.join(positives, ["anchor", "p"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", known("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % {LABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT * FROM r WHERE vec_id % {ANCHOR_EVERY} = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM a JOIN r ON r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
