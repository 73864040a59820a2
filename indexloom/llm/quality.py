"""Operator 2, quality rules: a short-circuit cascade.

Every rule is a function of a batch of texts. Each rule's cost (seconds a text) and what it rejects are measured on the
executors on a random sample of the table; the rule with the most rejections for its cost comes first, then the one with
the most among the texts that it lets pass, and so on. Each rule then only sees texts that all rules before it let pass,
with the arrays (words, their numbers) that those have made. The order changes the work, never the verdict: a text is
kept if no rule rejects it.

Where only kept documents are asked for (``filter_documents``) the base rule is one rule among the others; where its
features are results (``quality_report``) it runs on every text, and the others on what it lets pass.

Defined results: a null text counts as an empty one (no words, rejected by the base rule); very long texts are handled
whole, in the sample too; repeated rows are judged one by one, and ties (equal texts) alike; an empty table gives an
empty result; other columns, whatever their names, pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, split_words, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


class Batch:
    """Texts of one step with the arrays that rules share; each array is made when a rule first asks for it."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self._split: tuple[list[bytes], np.ndarray] | None = None
        self._ids: np.ndarray | None = None

    def narrow(self, keep: np.ndarray) -> Batch:
        """The marked texts, with what has been made for them so far."""
        out = Batch(list(compress(self.texts, keep)))
        if self._split is not None:
            of_words = np.repeat(keep, self.n_words)
            out._split = list(compress(self.words, of_words)), self.n_words[keep]
            out._ids = None if self._ids is None else self._ids[of_words]
        return out

    def split(self) -> tuple[list[bytes], np.ndarray]:
        if self._split is None:
            self._split = split_words(self.texts)
        return self._split

    @property
    def words(self) -> list[bytes]:
        return self.split()[0]

    @property
    def n_words(self) -> np.ndarray:
        return self.split()[1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.n_words)

    @property
    def ids(self) -> np.ndarray:
        """An integer for each word, equal for equal words."""
        if self._ids is None:
            known = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
            self._ids = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        return self._ids

    def sums(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=flags, minlength=len(self.texts)).astype(np.int64)


def word_chars(b: Batch) -> np.ndarray:
    gaps = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in b.texts]
    return np.asarray(gaps, np.int64)


def n_symbols(b: Batch) -> np.ndarray:
    return np.asarray([sum(map(t.count, SYMBOLS)) for t in b.texts], np.int64)


def n_lines(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line of their text."""
    out = []
    for t in b.texts:
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        out.append((len(lines), len(lines) - len(set(lines))))
    both = np.asarray(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def n_repeat_words(b: Batch) -> np.ndarray:
    """Words that lie in an 8-word window found twice or more in their text.

    Windows are found by a rolling hash that includes the text's number; those whose hash recurs are then compared
    word by word.
    """
    n = len(b.words)
    if n < WINDOW:
        return np.zeros(len(b.texts), np.int64)
    ids, doc = b.ids, b.doc
    x = mix64(ids.astype(np.uint64))
    h = mix64(doc[: n - WINDOW + 1].astype(np.uint64))
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h += x[k : n - WINDOW + 1 + k] * np.uint64(2 * mix64(np.array([k], np.uint64))[0] + np.uint64(1))
    whole = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    found: dict[tuple, int] = {}
    covered = np.zeros(n, bool)
    for i in np.sort(order[again]).tolist():
        first = found.setdefault((doc[i], ids[i : i + WINDOW].tobytes()), i)
        if first != i:
            covered[first : first + WINDOW] = covered[i : i + WINDOW] = True
    return b.sums(covered)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives, for each text of a batch, whether the rule turns it down."""

    name: str
    rejects: Callable[[Batch], np.ndarray]


def _symbols(b: Batch) -> np.ndarray:
    return 10 * n_symbols(b) > 3 * b.n_words


def _shouting(b: Batch) -> np.ndarray:
    return 10 * np.asarray([t.count("!") for t in b.texts], np.int64) > 3 * b.n_words


def _stutter(b: Batch) -> np.ndarray:
    same = np.zeros(len(b.words), bool)
    if len(b.words) > 1:
        same[1:] = (b.ids[1:] == b.ids[:-1]) & (b.doc[1:] == b.doc[:-1])
    return 10 * b.sums(same) > 3 * b.n_words


def _dup_lines(b: Batch) -> np.ndarray:
    lines, dup = n_lines(b)
    return (lines >= 4) & (10 * dup > 5 * lines)


def _word_length(b: Batch) -> np.ndarray:
    chars = word_chars(b)
    return (chars < 2 * b.n_words) | (chars > 15 * b.n_words)


#: Rules of production: the first column names them, thresholds are in the functions above.
RULES = (Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("stutter", _stutter), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length))

def base_failed(n_words: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)


BASE = Rule("base", lambda b: base_failed(b.n_words, n_repeat_words(b)))

#: Rows of the sample, as expected; costs and rejections are summed up where they lie, so no text comes to the driver.
SAMPLE_ROWS = 2048
SAMPLE_SEED = 20240229


def _profile(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """(pattern, n, costs): how many texts the rules whose bits are set turn down, and the seconds of each rule."""
    for batch in batches:
        for _, _, texts in slices(batch.column(0)):
            b, pattern, costs = Batch(texts), np.zeros(len(texts), np.int64), []
            b.ids  # noqa: B018  shared arrays are made before the clock starts
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                pattern |= rule.rejects(b).astype(np.int64) << i
                costs.append(time.perf_counter() - began)
            found, n = np.unique(pattern, return_counts=True)
            spread = [[c * k / len(texts) for c in costs] for k in n.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(spread, pa.list_(pa.float64()))], names=["pattern", "n", "costs"])


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds a text, share of the sample that it rejects of what the rules before it let pass), best first, ties by name."""
    n = docs.count()
    sample = docs.select(F.col(f"`{text}`").alias("text")).where(F.rand(SAMPLE_SEED) < min(1.0, rows / max(n, 1)))
    seconds = [F.sum(F.col("costs")[i]).alias(f"s{i}") for i in range(len(rules))]
    found = sample.mapInArrow(lambda batches: _profile(batches, rules), "pattern bigint, n bigint, costs array<double>").groupBy("pattern").agg(F.sum("n").alias("n"), *seconds).collect()  # at most 2 ** rules rows
    total = sum(r.n for r in found)
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    cost = [sum(r[f"s{i}"] for r in found) / total for i in range(len(rules))]
    alive, left, out = {r.pattern: r.n for r in found}, list(range(len(rules))), []
    while left:
        share = {i: sum(k for p, k in alive.items() if p >> i & 1) / total for i in left}
        best = min(left, key=lambda i: (-share[i] / max(cost[i], 1e-9), rules[i].name))
        out.append((rules[best], cost[best], share[best]))
        alive = {p: k for p, k in alive.items() if not p >> best & 1}
        left.remove(best)
    return out


def passes(batch: Batch, rules: list[Rule]) -> np.ndarray:
    """Whether each text passes every rule; a rule sees only what the rules before it let pass."""
    passed = np.ones(len(batch.texts), bool)
    for rule in rules:
        if not batch.texts:
            break
        keep = ~rule.rejects(batch)
        if not keep.all():
            passed[passed] = keep
            batch = batch.narrow(keep)
    return passed


def cascade(texts: list[str | None], rules: list[Rule]) -> np.ndarray:
    return passes(Batch(texts), rules)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: list[str | None], rules: list[Rule]) -> dict[str, np.ndarray]:
    """The base features of each text, whether the base rule turns it down, and whether it is kept."""
    b = Batch(texts)
    repeat = n_repeat_words(b)
    failed = base_failed(b.n_words, repeat)
    kept = np.zeros(len(texts), bool)
    kept[~failed] = passes(b.narrow(~failed), rules)
    return dict(zip((*FEATURES, "base_failed", "kept"), (b.n_words, word_chars(b), n_symbols(b), n_lines(b)[1], repeat, failed, kept), strict=True))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base features, base_failed and kept of every row of ``docs`` (columns doc_id, text)."""
    order = [r for r, _, _ in order_rules(docs, rules)]
    names = (*FEATURES, "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in slices(batch.column(1)):
                found = judge(texts, order)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *(pa.array(found[k]) for k in names)], names=["doc_id", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{f} bigint' for f in FEATURES)}, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the base rule and all others let pass, with all their columns."""
    order, at = [r for r, _, _ in order_rules(docs, (BASE, *rules))], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in slices(batch.column(at)):
                yield batch.slice(a, z - a).filter(pa.array(cascade(texts, order)))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM base WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM windows),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS lines, length(regexp_replace(t, '[^!]', '', 'g')) AS shouts,
         len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS stutters
  FROM base b LEFT JOIN covered c USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 10 * shouts > 3 * n_words OR 10 * stutters > 3 * n_words
         OR (lines >= 4 AND 10 * n_dup_lines > 5 * lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM g
"""
