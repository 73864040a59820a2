"""Connected components of a graph held in a DataFrame, by alternating large and small stars.

Nodes never leave the executors. Each round is two joins of the edges with one minimum for each node, in which a node
with very many edges is no task of its own; the rounds stop when the edges no longer change, which takes about as many
rounds as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, join_by_key


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are hung on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_by_key(both.where("v > u"), least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = gathered(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
    moved = join_by_key(down, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gathered(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), n)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; edges have columns u and v, which may be equal. A component is named after its least node.

    Rounds of few edges run in few tasks: no round has more edges than the first. A round is three queries, as the driver
    keeps threads, plans and records of each.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    n = 2 * edges.count()
    edges = gathered(edges, n)
    before = None
    while True:
        edges = cut(_small(cut(_large(edges, n)), n))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    return gathered(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct(), n)
