"""Operator 1, mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells of (source, language, topic) categories. A category is a value that a target names, or OTHER
for all values it does not name, so the number of cells is bounded by the targets, which are parameters. The tokens of
each cell are raked until the weighted tokens meet all three marginals; a document's probability is its cell's weight,
scaled so that the expected sample is ``budget`` of all tokens. Where that is above one, the cell is taken whole and the
others are raked again (``bounded_rake``). A keyed hash of the doc_id decides.

Topics, which the tables lack, are kinds of text by its form (``form_topic``); any column can be given instead.

Defined results: nulls in source, language or topic count as OTHER; where the named shares sum to one, OTHER keeps the
share of tokens that it has in the data, and the named ones share the rest (a target that names OTHER with 0 drops it); a null or empty text has no tokens and is sampled with its
cell's probability; texts of any length are read whole; ties of the hash are decided alike; a row without a doc_id is decided by its text; repeated rows are decided alike; shares of categories
without tokens go to the others in proportion; targets that no weights can meet are approached until ROUNDS have passed;
an empty table gives an empty result; other columns, whatever their names, pass through ``sample_documents`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

OTHER = "(other)"
ROUNDS = 500
TOLERANCE = 1e-10

Targets = dict[str, dict[str, float]]

#: Targets of production, as shares of tokens; what is left of one goes to OTHER, or its share in the data if nothing is.
TARGETS: Targets = {
    "source": {"src0": 0.2},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.18, "es": 0.12},
    "topic": {"article": 0.6, "long": 0.33, "brief": 0.03, "table": 0.04},
}
BUDGET = 0.5
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def form_topic(text: Column, tokens: Column) -> Column:
    return F.when(F.contains(text, F.lit(" | ")), "table").when(tokens >= 1000, "long").when(tokens < 100, "brief").otherwise("article")


def category(value: Column, target: dict[str, float]) -> Column:
    return F.when(value.isin(*target), value).otherwise(OTHER)


def shares(target: dict[str, float]) -> dict[str, float]:
    """A target with the share of OTHER written out."""
    rest = 1 - sum(v for k, v in target.items() if k != OTHER)
    if rest < -1e-9:
        raise ValueError(f"shares sum to more than one: {target}")
    return {**target, OTHER: max(rest, 0.0)}


def goal_shares(target: dict[str, float], had: float) -> dict[str, float]:
    """``shares``, but where the named ones leave nothing, OTHER keeps the share of tokens it had and they are scaled to the rest."""
    out = shares(target)
    if OTHER in target or out[OTHER] > 1e-9:
        return out
    return {**{k: v * (1 - had) for k, v in out.items()}, OTHER: had}


def rake(tokens: np.ndarray, marginals: list[np.ndarray]) -> np.ndarray:
    """Weights of cells, one axis a marginal, such that weighted tokens (as shares) have the marginals."""
    seed = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    fitted = seed.copy()
    axes = range(tokens.ndim)
    goals = []
    for axis, goal in enumerate(marginals):
        there = seed.sum(axis=tuple(a for a in axes if a != axis)) > 0
        goal = np.where(there, goal, 0.0)
        goals.append(goal / goal.sum() if goal.sum() else np.where(there, 1.0, 0.0) / max(there.sum(), 1))
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = fitted.sum(axis=tuple(a for a in axes if a != axis))
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
            factor = np.divide(goal, now, out=np.zeros_like(now), where=now > 0)
            fitted = fitted * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst < TOLERANCE:
            break
    return np.divide(fitted, seed, out=np.zeros_like(fitted), where=seed > 0)


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * weight) with the s at which the expected tokens are ``budget`` of all (or all that can be had)."""
    t, w = tokens.ravel().astype(float), weights.ravel()
    goal = budget * t.sum()
    order = np.argsort(-w)
    full = 0.0  # tokens of the cells that are taken whole
    rest = float((t * w).sum())
    s = math.inf
    for i in order:
        if w[i] <= 0 or rest <= 0:
            break
        s = (goal - full) / rest
        if s * w[i] <= 1:
            break
        full, rest, s = full + t[i], rest - t[i] * w[i], math.inf
    return np.where(weights > 0, np.minimum(1.0, np.minimum(s, 1e300) * weights), 0.0)


def _goals(goal: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt in the shares of ``goal``; a category with less room gets what it has, the others the rest in proportion."""
    out, left = np.zeros_like(room), goal > 0
    while left.any():
        dealt = np.where(left, goal, 0.0) / goal[left].sum() * max(total - out[~left].sum(), 0.0)
        full = left & (dealt >= room)
        if not full.any():
            return np.where(left, dealt, out)
        out[full] = room[full]
        left &= ~full
    return out


def bounded_rake(tokens: np.ndarray, weights: np.ndarray, marginals: list[np.ndarray], budget: float) -> np.ndarray:
    """Probabilities of cells, one at most, whose expected tokens are ``budget`` of all and meet the marginals as far as there are tokens.

    Without a cut at one these are the raked weights, scaled. Where cells are taken whole, the others of their category
    make up for them; a category that has too few tokens is taken whole, and the others share the rest in proportion.
    """
    there = (weights > 0) & (tokens > 0)
    t = np.where(there, tokens, 0).astype(float)
    p = probabilities(tokens, weights, budget)
    if not (p[there] >= 1).any():
        return p
    free = np.where(there, weights, 0.0)  # a product of one factor a category, before the cut
    total = min(budget * tokens.sum(), t.sum())
    axes = range(t.ndim)
    goals = [_goals(goal, t.sum(axis=tuple(a for a in axes if a != axis)), total) for axis, goal in enumerate(marginals)]
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, goal in enumerate(goals):
            tt, ff = np.moveaxis(t, axis, 0), np.moveaxis(free, axis, 0)
            for i, wanted in enumerate(goal):
                room = tt[i].sum()
                if room > 0:
                    worst = max(worst, abs(float((tt[i] * np.minimum(1, ff[i])).sum()) - wanted) / total)
                    q = probabilities(tt[i], ff[i], wanted / room)
                    at = np.argmax(np.where((tt[i] > 0) & (q < 1), ff[i], 0.0))
                    low = np.min(ff[i][tt[i] > 0])
                    scale = q.flat[at] / ff[i].flat[at] if ((tt[i] > 0) & (q < 1)).any() else 1 / low
                    ff[i] = np.where(tt[i] > 0, np.clip(ff[i] * scale, 1e-12, 1e12), 0.0)
        if worst < TOLERANCE:
            break
    return probabilities(tokens, free, budget)


def _with_cells(docs: DataFrame, targets: Targets, topic: Column | None) -> DataFrame:
    """row (a struct of all columns, so that no name can clash), tokens and the categories source, lang and topic."""
    kind = form_topic(F.col("text"), n_tokens(F.col("text"))) if topic is None else topic
    out = docs.select(F.struct("*").alias("row"), n_tokens(F.col("text")).alias("tokens"), F.col("source").alias("s"), F.col("lang").alias("l"), kind.alias("t"))
    return out.select("row", "tokens", category(F.col("s"), targets["source"]).alias("source"), category(F.col("l"), targets["lang"]).alias("lang"), category(F.col("t"), targets["topic"]).alias("topic"))


def calibrate(docs: DataFrame, targets: Targets = TARGETS, budget: float = BUDGET, topic: Column | None = None) -> dict[tuple[str, str, str], tuple[float, float]]:
    """(weight, probability) of every cell; at most one row a cell comes to the driver."""
    names = {k: list(shares(v)) for k, v in targets.items()}
    cells = _with_cells(docs, targets, topic).groupBy("source", "lang", "topic").agg(F.sum("tokens"))
    tokens = np.zeros([len(names[k]) for k in ("source", "lang", "topic")])
    for s, l, t, n in cells.collect():
        tokens[names["source"].index(s), names["lang"].index(l), names["topic"].index(t)] = n
    marginals = []
    for axis, k in enumerate(("source", "lang", "topic")):
        had = tokens.sum(axis=tuple(a for a in range(3) if a != axis))[names[k].index(OTHER)] / max(tokens.sum(), 1)
        marginals.append(np.array([goal_shares(targets[k], had)[v] for v in names[k]]))
    weights = rake(tokens, marginals)
    p = bounded_rake(tokens, weights, marginals, budget)
    return {(s, l, t): (float(weights[i, j, k]), float(p[i, j, k])) for i, s in enumerate(names["source"]) for j, l in enumerate(names["lang"]) for k, t in enumerate(names["topic"])}


def _draw(seed: str) -> Column:
    """A number in [0, 1) for each row, from its doc_id or else its text."""
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("row.text", F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _sampled(docs: DataFrame, targets: Targets, budget: float, seed: str, topic: Column | None) -> DataFrame:
    rows = [(*cell, *both) for cell, both in calibrate(docs, targets, budget, topic).items()]
    spark = docs.sparkSession
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double")
    joined = _with_cells(docs, targets, topic).join(F.broadcast(cells), ["source", "lang", "topic"])  # as many rows as the targets have cells
    return joined.withColumn("sampled", _draw(seed) < F.col("probability"))


def mixture(docs: DataFrame, targets: Targets = TARGETS, budget: float = BUDGET, seed: str = SEED, topic: Column | None = None) -> DataFrame:
    """doc_id, its categories, n_tokens, weight, probability and sampled of every row of ``docs``."""
    out = _sampled(docs, targets, budget, seed, topic)
    return out.select("row.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "sampled")


def sample_documents(docs: DataFrame, targets: Targets = TARGETS, budget: float = BUDGET, seed: str = SEED, topic: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    return _sampled(docs, targets, budget, seed, topic).where("sampled").select("row.*")


def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
