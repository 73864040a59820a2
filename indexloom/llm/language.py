"""Operator 7, language identification: scripts narrow candidates, Viterbi labels spans.

A model is counts of character trigrams and whole words, in hashed buckets, for each language, gathered on the executors
from all training rows; its size is bounded by the number of languages (at most MAX_LANGUAGES) times BUCKETS. A word's
score for a language is the log-likelihood of its features. Languages that hardly ever use the script of a word are no
candidates for it. Along a text, Viterbi's algorithm picks the labels with the best sum of scores less PENALTY for each
switch, which gives spans; the text's language is the one with the most words. All texts of a step advance together.

Defined results: words are maximal runs outside ASCII white space, lower-cased, of which only letters (general category L)
and the marks after them count; words without a letter join the span they stand in; a text that is null or has no letter
is ``und`` with score 0 and no spans; ties go to the language that sorts first; repeated rows get equal predictions; texts
of any length are read whole; without any training row every text is ``und``; an empty table gives an empty result; only
doc_id and text are read, so that no other column, whatever its name, plays a part.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, slices, split_words, table

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
PENALTY = 14.0
SMOOTHING = 0.5
#: A language is a candidate for a script that holds this share of its training words.
SCRIPT_SHARE = 0.001
NEVER = -60.0
STEP_BYTES = 4_000_000
UNKNOWN = "und"

# First code points of ranges, and the script of each.
RANGES = [
    (0x0, "other"), (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS, _SCRIPT = [a for a, _ in RANGES], [SCRIPTS.index(s) for _, s in RANGES]


def letters_of(word: str) -> str:
    """The letters of a word, with the marks that follow one."""
    if word.isalpha():
        return word
    kept = "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M")
    first = next((i for i, c in enumerate(kept) if c.isalpha()), len(kept))
    return kept[first:]


def script(letter: str) -> int:
    return _SCRIPT[bisect.bisect_right(_STARTS, ord(letter)) - 1]


class Words:
    """The different words of a step: what to look up for each occurrence, and the features of each word."""

    def __init__(self, texts: list[str | None]):
        raw, self.counts = split_words(texts)
        known = {w: i for i, w in enumerate(dict.fromkeys(raw))}
        self.at = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
        letters = [letters_of(w.decode("utf-8", "surrogatepass").lower()) for w in known]
        self.script = np.array([script(w[0]) if w else -1 for w in letters], np.int64)
        points = np.frombuffer(("  ".join(["", *letters, ""])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in letters], np.int64)
        start = np.concatenate(([2], 2 + np.cumsum(size + 2)))[:-1] if len(letters) else np.zeros(0, np.int64)
        n = np.where(size > 0, size + 1, 0)  # trigrams over one blank before and one after, and the word itself
        self.first = np.cumsum(n) - n
        self.n = n
        word = np.repeat(np.arange(len(letters)), n)
        k = np.arange(len(word)) - self.first[word]
        base = start[word] - 1 + k
        whole = k == size[word]
        base = np.minimum(base, len(points) - 3)
        with np.errstate(over="ignore"):
            h = (points[base] * np.uint64(0x9E3779B1) + points[base + 1]) * np.uint64(0x85EBCA77) + points[base + 2]
            own = np.fromiter((hash_word(w) for w in letters), np.uint64, len(letters))
            h = np.where(whole, own[word], h)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        self.word = word


def hash_word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket by language
    candidate: np.ndarray  # script by language

    def scores(self, words: Words) -> np.ndarray:
        """A row of scores for each different word; words without a letter, or of a script that no language has, say nothing."""
        out = np.zeros((len(words.n), len(self.languages)), np.float32)
        some = words.n > 0
        if some.any():
            for j in range(len(self.languages)):
                out[some, j] = np.add.reduceat(self.log_p[words.bucket, j], words.first[some])
        of_script = self.candidate[np.maximum(words.script, 0)]
        out[~of_script & some[:, None]] += NEVER
        out[some & ~of_script.any(axis=1)] = 0
        return out - out.max(axis=1, keepdims=True, initial=-np.inf) if out.size else out


def viterbi(scores: np.ndarray, at: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every occurrence; ``at`` gives its row of scores, ``counts`` the occurrences of each text in turn."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    labels = np.zeros(len(at), np.int16)
    if not len(at):
        return labels
    stays = np.zeros((len(at), -(-scores.shape[1] // 8)), np.uint8)  # a bit for each language
    came = np.zeros(len(at), np.int16)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t occurrences
    v = scores[at[first[: alive[0]]]]
    finals = np.zeros(len(counts), np.int16)
    for t in range(1, size[0] + 1):
        k = alive[t] if t < size[0] else 0
        if k < len(v):
            finals[k : len(v)] = v[k:].argmax(axis=1)
            v = v[:k]
        if not k:
            break
        best = v.argmax(axis=1)
        top = v[np.arange(k), best][:, None] - penalty
        i = first[:k] + t
        stay = v >= top
        stays[i], came[i] = np.packbits(stay, axis=1), best
        v = np.where(stay, v, top) + scores[at[i]]
    now = np.zeros(len(counts), np.int16)
    for t in range(size[0] - 1, -1, -1):
        k = alive[t]
        fresh = alive[t + 1] if t + 1 < size[0] else 0
        now[fresh:k] = finals[fresh:k]
        i = first[:k] + t
        labels[i] = now[:k]
        stay = stays[i, now[:k] >> 3] >> (7 - (now[:k] & 7)) & 1
        now[:k] = np.where(stay, now[:k], came[i])
    return labels


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bucket, n): features (kind 0) and scripts (kind 1) of the training rows of a partition."""
    features: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, z, texts in slices(batch.column(1)):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).slice(a, z - a).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                w = Words(own)
                times = np.bincount(w.at, minlength=len(w.n))
                features.setdefault(lang, np.zeros(BUCKETS, np.int64))
                features[lang] += np.bincount(w.bucket, weights=times[w.word], minlength=BUCKETS).astype(np.int64)
                scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
                scripts[lang] += np.bincount(w.script[w.script >= 0], weights=times[w.script >= 0], minlength=len(SCRIPTS)).astype(np.int64)
    for kind, counts in ((0, features), (1, scripts)):
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "kind", "bucket", "n"])


def train(rows: DataFrame) -> Model:
    """A model of all ``rows`` (columns text and lang, nulls are passed over)."""
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = labelled.mapInArrow(_count, "lang string, kind int, bucket int, n bigint").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds {MAX_LANGUAGES}")
    number = {lang: j for j, lang in enumerate(languages)}
    features, scripts = np.full((BUCKETS, len(languages)), SMOOTHING), np.zeros((len(SCRIPTS), len(languages)))
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    kind, bucket, n = (counts.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    features[bucket[kind == 0], lang[kind == 0]] += n[kind == 0]
    scripts[bucket[kind == 1], lang[kind == 1]] = n[kind == 1]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(features / features.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE)


def label(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label of each word of all texts, whether it has a letter, and the number of words of each text."""
    words = Words(texts)
    return viterbi(model.scores(words), words.at, words.counts, penalty), (words.n > 0)[words.at], words.counts


def _spans(text: str, labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1)).tolist()
    begins = [m.start() for m in re.finditer(WORD, text)] if len(edges) > 1 else [0]
    starts = [0, *(begins[e] for e in edges[1:])]
    return [(a, z, languages[labels[e]]) for a, z, e in zip(starts, [*starts[1:], len(text)], edges, strict=True)]


def spans(text: str, model: Model, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
    """(start, stop, language) of each span of a text that has a letter, in code points; spans cover the text."""
    labels, lettered, _ = label([text], model, penalty)
    return _spans(text, labels, model.languages) if lettered.any() else []


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id``, lang_pred, score (the share of lettered words that it labels), n_spans and spans; only text is an input of a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        n = max(len(m.languages), 1)
        for batch in batches:
            for a, z, texts in slices(batch.column(1), STEP_BYTES):
                if m.languages:
                    labels, lettered, counts = label(texts, m, penalty)
                else:
                    labels, lettered, counts = np.zeros(0, np.int16), np.zeros(0, bool), np.zeros(len(texts), np.int64)
                of = np.repeat(np.arange(len(texts)), counts)
                votes = np.bincount(of[lettered] * n + labels[lettered], minlength=len(texts) * n).reshape(-1, n)
                total, most = votes.sum(axis=1), votes.max(axis=1)
                names = [m.languages[j] if t else UNKNOWN for j, t in zip(votes.argmax(axis=1).tolist(), total.tolist(), strict=True)]
                own = np.split(labels, np.cumsum(counts)[:-1])
                found = [[{"start": s, "stop": e, "lang": x} for s, e, x in _spans(t, w, m.languages)] if k else [] for t, w, k in zip(texts, own, total.tolist(), strict=True)]
                columns = [pa.array(names, pa.string()), pa.array(most / np.maximum(total, 1)), pa.array([len(f) for f in found], pa.int64()), pa.array(found, item)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *columns], names=["doc_id", "lang_pred", "score", "n_spans", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_spans bigint, spans array<struct<start:int,stop:int,lang:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(F.coalesce(~held_out, F.lit(True))))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans", "spans")
