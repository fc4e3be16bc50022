"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is a row of words (runs of letters and digits) and signs (runs of what is neither these nor white space). Each
has two forms: itself in lower case, and its shape (upper, title, lower or mixed case, digits, or the signs themselves,
and whether it repeats one of the two before it). Features are n-grams of these: one and two words, and one to three
shapes. Each is hashed to one of ``2 ** BITS`` buckets; its value is its share among the text's n-grams of its kind,
times ``SPREAD``. A score is the logistic function of a sparse dot product.

Training is FTRL-Proximal (McMahan et al. 2013): per bucket it keeps the sum z of gradients, less what earlier weights
take off, and the sum n of their squares; a weight is 0 while |z| is at most L1, else
``(sign(z) * L1 - z) / ((BETA + sqrt(n)) / ALPHA + L2)``. Rows come in the order of a hash of doc_id, ``EPOCHS`` times.

The classifier is fitted on a bounded sample: of the labelled documents that aren't held out at most ``MAX_HIGH`` with
quality 1 and ``MAX_LOW`` with quality 0, those with the least hash of doc_id; a row is left out if with it the sample
would have more than ``MAX_FEATURES`` features, and the ones behind it aren't. Everything is scored: whole texts of all
documents. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null text counts as empty; an empty text, or one of white space, has no n-grams and gets the fitted
intercept; without labelled documents of both classes nothing is known and every score is 0.5; a document labelled twice
counts as bad if one label says so; of rows that repeat a labelled doc_id the one with the least text is learnt from,
and all are scored; a null doc_id isn't held out and is never learnt from; a very long text is scored whole, a part at a
time; other columns are ignored by ``score`` and kept by ``filter_low``; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches, by_hash, cut, likely_sample, mix

BITS = 20
MAX_LOW, MAX_HIGH, MAX_FEATURES = 6000, 12_000, 24_000_000
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.05, 0.01
EPOCHS = 3
SPREAD = 4.0
#: What a score's documents need to be kept.
THRESHOLD = 0.7
#: Kinds of n-grams: (whether of shapes, how many).
KINDS = ((False, 1), (False, 2), (True, 1), (True, 2), (True, 3))
#: A task remembers so many different words, none longer than so many characters.
MEMO_WORDS, MEMO_CHARS = 200_000, 48
#: A text's words are taken in parts of so many characters; about so many words are hashed at a time.
_PART, _WORDS = 1 << 20, 100_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SEED = mix(np.arange(1, len(KINDS) + 1, dtype=np.uint64))
_REPEATED = np.uint64(0x9E3779B97F4A7C15)
#: Signs longer than this have one shape with their beginning.
_SIGNS = 4


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo 4; rows with 2 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def shape_of(token: str) -> str:
    if not (token[0].isalnum()):
        return token[:_SIGNS]
    if token.isdigit():
        return "9"
    if len(token) > 1 and token.isupper():
        return "XX"
    if token.islower():
        return "x"
    return "Xx" if token[0].isupper() and token[1:].islower() or len(token) == 1 else "xX"


class Hasher(dict):
    """Hashes of tokens and of their shapes; those that a task has met are remembered, within bounds."""

    def __missing__(self, token: str) -> tuple[int, int]:
        found = xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape_of(token), 1)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[token] = found
        return found

    def grams(self, segments: list[tuple[list[str], int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By kind of n-gram: its place in ``KINDS``, the buckets of all n-grams of the segments, and whose they are.

        A segment is some tokens, of which the first few only lead to it: n-grams among these alone belong to the one before.
        """
        size = np.array([len(tokens) for tokens, _ in segments], np.int64)
        owner = np.repeat(np.arange(len(segments)), size)
        own = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat([led for _, led in segments], size)
        both = np.array([self[t] for tokens, _ in segments for t in tokens], np.uint64).reshape(-1, 2)
        words, shapes = both[:, 0], both[:, 1].copy()
        again = np.zeros(len(words), bool)
        for back in (1, 2):
            again[back:] |= (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
        shapes[again] ^= _REPEATED
        for kind, (of_shapes, n) in enumerate(KINDS):
            single = shapes if of_shapes else words
            last = len(single) - n + 1
            if last <= 0:
                continue
            value = np.full(last, _SEED[kind], np.uint64)
            for i in range(n):
                value = mix(value + single[i : last + i])
            inside = (owner[:last] == owner[n - 1 :]) & own[n - 1 :]
            yield kind, (value >> np.uint64(64 - BITS)).astype(np.int64)[inside], owner[:last][inside]


def segments_of(text: str) -> Iterator[tuple[list[str], int]]:
    """A text's tokens, of a long text by parts, each led by the last four tokens before it; without white space a part ends anywhere."""
    led: list[str] = []
    at = 0
    while at < len(text) or not at:
        end = at + _PART
        while end < len(text) and not text[end].isspace() and end < at + 2 * _PART:
            end += 1
        found = _TOKEN.findall(text if not at and end >= len(text) else text[at:end])
        yield led + found, len(led)
        led = (led + found)[-4:]
        at = end


def grouped(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, list[tuple[list[str], int]]]]:
    """Segments in groups of bounded size, with the numbers of the texts that they belong to."""
    whose: list[int] = []
    held: list[tuple[list[str], int]] = []
    n = 0
    for i, text in enumerate(texts):
        for segment in segments_of(text):
            whose.append(i)
            held.append(segment)
            n += len(segment[0])
            if n > _WORDS:
                yield np.array(whose), held
                whose, held, n = [], [], 0
    if held:
        yield np.array(whose), held


def features(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, ascending, and their values."""
    by_kind: dict[int, list[np.ndarray]] = {k: [np.zeros(0, np.int64), np.zeros(0, np.int64)] for k in range(len(KINDS))}
    for _, segments in grouped([text]):
        for kind, bucket, _ in hasher.grams(segments):
            new, n = np.unique(bucket, return_counts=True)
            known, had = by_kind[kind]
            at, which = np.unique(np.concatenate([known, new]), return_inverse=True)
            by_kind[kind] = [at, np.bincount(which, np.concatenate([had, n]), len(at)).astype(np.int64)]
    buckets = np.concatenate([b for b, _ in by_kind.values()])
    values = np.concatenate([SPREAD * n / max(1, n.sum()) for _, n in by_kind.values()])
    found, which = np.unique(buckets, return_inverse=True)
    return found, np.bincount(which, values, len(found))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        """Scores of texts: dot products of their shares with the weights."""
        sums, counts = np.zeros((2, len(KINDS), len(texts)))
        for whose, segments in grouped(texts):
            for kind, bucket, owner in hasher.grams(segments):
                text = whose[owner]
                sums[kind] += np.bincount(text, self.weights[bucket], len(texts))
                counts[kind] += np.bincount(text, minlength=len(texts))
        total = self.intercept + SPREAD * (sums / np.maximum(counts, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


class Learner:
    """FTRL-Proximal for logistic loss: the sums z and n of every bucket, and of the intercept, which isn't drawn to 0."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.z0 = self.n0 = 0.0

    @property
    def intercept(self) -> float:
        return -self.z0 * ALPHA / (BETA + self.n0**0.5)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, y: int) -> None:
        """One row: its different buckets, their values, its class."""
        w, w0 = self.weights(at), self.intercept
        error = 1 / (1 + np.exp(-np.clip(w0 + w @ values, -40, 40))) - y
        g = error * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.z0 += error - ((self.n0 + error * error) ** 0.5 - self.n0**0.5) / ALPHA * w0
        self.n0 += error * error


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents to learn from: doc_id, quality, text. Labels without a document take nobody's place."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(fold(F.col("doc_id")) != 2)
    known = cut(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = []
    for quality, most in ((1, MAX_HIGH), (0, MAX_LOW)):
        near = likely_sample(known.filter(F.col("quality") == quality), "doc_id", most, sizes.get(quality, 0))
        parts.append(near.orderBy(*by_hash("doc_id")).limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most MAX_HIGH + MAX_LOW rows of two numbers
    return texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None without labelled documents of both classes. Tasks make features; one task, for the sample is bounded, learns."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in rows:
            found = [features(x.as_py(), hasher) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                ["doc_id", "quality", "buckets", "shares"],
            )

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        room, seen = MAX_FEATURES, set()
        for batch in rows:
            for quality, at, values in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if len(at.values) <= room:
                    room -= len(at.values)
                    seen.add(quality)
                    held.append((at.values.to_numpy(), values.values.to_numpy(), quality))
        if len(seen) == 2:
            learner = Learner()
            for _ in range(EPOCHS):
                for at, values, quality in held:
                    learner.learn(at, values, quality)
            w = learner.weights().astype(np.float32)
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(w[used], learner.intercept))], ["bucket", "weight"])

    made = batches(sample(docs, labels), make, "doc_id long, quality int, buckets array<int>, shares array<float>")
    ordered = cut(made).repartition(1).sortWithinPartitions(*by_hash("doc_id"))
    found = batches(ordered, learn, "bucket int, weight double").toArrow()  # at most 2 ** BITS + 1 rows
    if not found.num_rows:
        return None
    at, weight = found.column("bucket").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[at[at >= 0]] = weight[at >= 0]
    return Model(weights, float(weight[at < 0][0]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # 2 ** BITS numbers of four bytes

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in rows:
            found = scored(model.value, batch.column(2), hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(F.col("doc_id").cast("long")), F.lit(0)) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return batches(source, rate, "doc_id long, held_out boolean, score double, predicted int")


def filter_low(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in rows:
            yield batch.filter(pa.array(scored(model.value, batch.column(text), hasher) >= threshold))

    return batches(docs, keep, docs.schema)


def scored(model: Model | None, texts: pa.Array, hasher: Hasher) -> np.ndarray:
    """The scores of a batch's texts."""
    return np.full(len(texts), 0.5) if model is None else model.scores([x.as_py() or "" for x in texts], hasher)
