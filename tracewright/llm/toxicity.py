"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models over the letters of words, one of toxic and one of ordinary texts. Only the highest order is
counted by class; all lower orders are continuation counts (after how many different letters a sequence occurs) that
both classes share. A rare expression thus gets the same weight from the shared counts in both models and says little
about the class, while forms of an expression that is typical of a class still speak for it:

    p_c(x | h) = (max(n_c(h x) - D, 0) + (D * kinds_c(h) + S) * both(x | h)) / (n_c(h) + S)
    both(x | h) = max(n(h x) - D, 0) / n(h) + D * kinds(h) / n(h) * shared(x | h')

``h`` is the ``ORDER - 1`` letters before ``x`` in its word, padded at the word's start; ``h'`` drops the first one;
``n`` is of both classes together. The strength ``S`` (as in the Pitman-Yor form of these models) keeps a class with
few texts close to what both share.

The evidence of a text is the difference of its length-normalised log-likelihoods, toxic less ordinary; beside it
stands the part of that difference that comes from marked expressions, whose own difference exceeds ``MARGIN``, since
thousands of ordinary words would drown a few of those. The score is a logistic function of both, per word, per root
of the length and (the marked part) as a logarithm of the sum, fitted on training rows that the counts didn't use.

The model is fitted on a bounded sample of labelled rows: of the training rows at most ``MAX_TOXIC`` toxic and
``MAX_ORDINARY`` ordinary ones, those with the least hash of doc_id, and of these, in that order, each that fits into
what is left of ``MAX_CHARS`` characters; a text longer than a ``LEAST_ROWS``-th of them is learnt from up to there.
Labels without a document don't count. All of their sequences are in the model; tasks hold it as two sorted arrays of 64-bit
hashes with a value each, 12 bytes a sequence. Everything is scored: whole texts of all documents. Labels, language,
source and doc_id are no inputs of a score.

Defined results: a null text counts as empty; an empty text has no evidence and gets the fitted intercept; without
labelled rows of both classes, both among the rows to count and among those to weigh, nothing is known and every score
is 0; a document labelled twice counts as toxic if one label says so; of rows that repeat a labelled doc_id the one with
the least text is learnt from, and all are scored; a very long text is scored whole, its words a part at a time; other
columns are ignored by ``score`` and kept by ``filter_toxic``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches, by_hash, cut, fitting, likely_sample, mix

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 6000, 24_000_000
#: A row gives the sample at most its part of the characters, if so many rows share them.
LEAST_ROWS = 16
#: Letters in a sequence of the highest order.
ORDER = 6
#: Discount of every order.
DISCOUNT = 0.75
#: How many observations of a context the shared counts are worth against a class's own.
STRENGTH = 60.0
#: A word is a marked expression where its log-likelihoods differ by more than this.
MARGIN = 1.0
#: Before and after a word.
PAD, STOP = "\x02", "\x03"
#: Outer characters that don't belong to a word.
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&"
#: A task remembers so many words, none longer than so many letters; longer and newer ones are worked out again.
MEMO_WORDS, MEMO_CHARS = 200_000, 48
#: A task's counts are passed on when it holds so many different items.
FLUSH_ITEMS = 100_000
#: A text's words are taken in parts of so many characters.
_PART = 1 << 20
#: About so many words are scored at a time.
_WORDS = 50_000
_LETTER = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo 4; rows with 2 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def parts_of(text: str) -> Iterator[str]:
    """A text in parts that end at white space, so that a very long one is never a list of words as a whole."""
    at = 0
    while len(text) - at > _PART:
        end = at + _PART
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def words_of(text: str) -> list[str]:
    """Lower-cased words without outer punctuation; what is left empty is dropped."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGES))]


def grams_of(word: str) -> list[str]:
    """The sequences of ``ORDER`` letters of a word, one for each letter and one for its end."""
    padded = PAD * (ORDER - 1) + word + STOP
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def hashes(letters: np.ndarray) -> np.ndarray:
    """64 bits for each row of letters (code points)."""
    out = np.full(len(letters), letters.shape[1], np.uint64)
    for k in range(letters.shape[1]):
        out = mix(out + letters[:, k].astype(np.uint64) * _LETTER[k])
    return out


@dataclass
class Model:
    """Hashes of seen sequences and of seen contexts, both sorted, with log-likelihoods toxic less ordinary; logistic weights."""

    seen: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    backs: np.ndarray
    weights: np.ndarray | None = None

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words, toxic less ordinary. What isn't seen differs by the contexts' back-off weights alone."""
        if not words:
            return np.zeros(0)
        pad = PAD * (ORDER - 1)
        code = np.frombuffer((pad + (STOP + pad).join(words) + STOP).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1  # as many sequences as letters, and one for the end
        starts = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(np.arange(len(words)) * (ORDER - 1), length)
        windows = np.lib.stride_tricks.sliding_window_view(code, ORDER)[at]
        found, value = _lookup(hashes(windows), self.seen, self.values)
        if not found.all():
            value[~found] = _lookup(hashes(windows[~found, :-1]), self.contexts, self.backs)[1]
        return np.add.reduceat(value, starts)


def _lookup(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their values; 0 for others."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    return found, np.where(found, values[at].astype(float) if len(known) else 0.0, 0.0)


class Scorer(dict):
    """A model with the ratios of the words that a task has met; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def _evidence(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self})
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = list(set(words))
        self.update(zip(new, self.model.ratios(new).tolist()))
        found = np.fromiter(map(self.__getitem__, words), float, len(words))
        for w in new:
            if len(w) > MEMO_CHARS:
                del self[w]
        return found

    def features(self, texts: Iterable[str]) -> np.ndarray:
        """By text: a constant; the evidence per word and per root of the length; the marked part likewise, and the logarithm of its sum."""
        n, total, marked = [], [], []
        words: list[str] = []
        owners: list[int] = []
        lengths: list[int] = []

        def add() -> None:
            found = self._evidence(words)
            owner = np.repeat(owners, lengths)
            for sums, values in ((total, found), (marked, np.maximum(found - MARGIN, 0))):
                for i, x in enumerate(np.bincount(owner, values, len(n))[owners[0] :].tolist(), owners[0]):
                    sums[i] += x
            words.clear()
            owners.clear()
            lengths.clear()

        for i, text in enumerate(texts):
            for sums in (n, total, marked):
                sums.append(0)
            for part in parts_of(text):
                own = words_of(part)
                n[i] += len(own)
                words += own
                owners.append(i)
                lengths.append(len(own))
                if len(words) > _WORDS:
                    add()
        if words:
            add()
        n, total, marked = np.maximum(1, n), np.array(total, float), np.array(marked, float)
        return np.stack([np.ones(len(n)), total / n, total / np.sqrt(n), marked / n, marked / np.sqrt(n), np.log1p(marked)], axis=1)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.weights, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: text, toxic, and whether a row is for the weights rather than the counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_fold", fold(F.col("doc_id"))).filter("_fold <> 2")
    # labels of other corpora's documents take nobody's place
    known = cut(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        near = likely_sample(known.filter(F.col("toxic") == toxic), "doc_id", most, sizes.get(toxic, 0))
        parts.append(near.orderBy(*by_hash("doc_id")).limit(most))
    known = parts[0].union(parts[1]).select("doc_id", (F.col("_fold") == 3).alias("for_weights"), "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most MAX_TOXIC + MAX_ORDINARY rows of three numbers; an id that repeats is one row behind this
    met = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "for_weights", "toxic").agg(F.min("text").alias("text"))
    rows = cut(met.withColumn("text", F.substring("text", 1, max(1, MAX_CHARS // LEAST_ROWS))))
    lengths = rows.select("doc_id", F.length("text").alias("n")).orderBy(*by_hash("doc_id")).collect()  # as many rows
    taken = fitting([r["n"] for r in lengths], MAX_CHARS)
    if len(taken) == len(lengths):
        return rows
    ids = rows.sparkSession.createDataFrame([(lengths[i]["doc_id"],) for i in taken], "doc_id long")
    return rows.join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None without rows of both classes to count and to weigh."""
    rows = sample(docs, labels)
    shape = "toxic int, item string, n long"

    def count_words(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches_in:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for part in parts_of(text.as_py()):
                    found.update((toxic, w) for w in words_of(part))
                    if len(found) > FLUSH_ITEMS:
                        yield from _counted(found)
        yield from _counted(found)

    def count_grams(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches_in:
            for toxic, word, n in zip(*(x.to_pylist() for x in batch.columns)):
                for gram in grams_of(word):
                    found[toxic, gram] += n
                if len(found) > FLUSH_ITEMS:
                    yield from _counted(found)
        yield from _counted(found)

    kept = rows.filter(~F.col("for_weights")).select("text", "toxic")
    words = batches(kept, count_words, shape).groupBy("toxic", "item").agg(F.sum("n").alias("n"))
    grams = batches(words, count_grams, shape).groupBy("item").agg(F.sum(F.expr("if(toxic = 0, n, 0)")).alias("n0"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("n1"))
    found = grams.toArrow()  # at most as many rows as the sample has characters and words, MAX_CHARS in all
    counts = np.stack([found.column(x).to_numpy().astype(np.int64) for x in ("n0", "n1")], axis=1)
    if not counts.any(axis=0).all():
        return None
    letters = np.frombuffer("".join(found.column("item").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    model = smoothed(letters, counts)

    def weigh(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches_in:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(scorer.features(x.as_py() for x in batch.column(0))), pa.list_(pa.float64()))], ["toxic", "features"])

    # at most MAX_TOXIC + MAX_ORDINARY rows
    seen = batches(rows.filter("for_weights").select("text", "toxic"), weigh, "toxic int, features array<double>").collect()
    if len({r["toxic"] for r in seen}) < 2:
        return None
    model.weights = logistic(np.array([r["features"] for r in seen]), np.array([r["toxic"] for r in seen], dtype=float))
    return model


def _counted(found: Counter) -> Iterator[pa.RecordBatch]:
    """Counts by (toxic, item), which are forgotten."""
    out = list(found.items())
    found.clear()
    for i in range(0, len(out), 50_000):
        part = out[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.int32()), pa.array([k[1] for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["toxic", "item", "n"])


def lower_orders(letters: np.ndarray) -> tuple[np.ndarray, float]:
    """The shared probability of each sequence's last letter after all others but the first, and that of an unknown letter."""
    levels = []
    rows = letters
    while rows.shape[1] > 1:  # continuation counts: how many different letters stand before a sequence
        rows = rows[:, 1:]
        _, first, which, continued = np.unique(hashes(rows), return_index=True, return_inverse=True, return_counts=True)
        rows = rows[first]
        levels.append((rows, which, continued))
    floor = 1.0 / (len(rows) + 1)
    below = np.full(len(rows), floor)
    for rows, which, n in reversed(levels):
        _, context = np.unique(hashes(rows[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(context, n)[context], np.bincount(context)[context]
        own = (n - DISCOUNT + DISCOUNT * kinds * below) / total
        below = own[which]
    return below, floor


def smoothed(letters: np.ndarray, counts: np.ndarray) -> Model:
    """The two models from different sequences of the highest order and their counts (ordinary, toxic)."""
    below, _ = lower_orders(letters)
    contexts, context = np.unique(hashes(letters[:, :-1]), return_inverse=True)
    every = counts.sum(axis=1)
    kinds = np.bincount(context)
    both = (every - DISCOUNT + DISCOUNT * kinds[context] * below) / np.bincount(context, every)[context]
    logs, backs = [], []
    for own in counts.T:
        total = np.bincount(context, own) + STRENGTH
        back = (DISCOUNT * np.bincount(context, own > 0) + STRENGTH) / total
        logs.append(np.log(np.maximum(own - DISCOUNT, 0) / total[context] + back[context] * both))
        backs.append(np.log(back))
    keys = hashes(letters)
    order = np.argsort(keys)
    return Model(keys[order], (logs[1] - logs[0])[order].astype(np.float32), contexts, (backs[1] - backs[0]).astype(np.float32))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; columns are scaled meanwhile."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            found = np.zeros(batch.num_rows) if model is None else scorer.scores(x.as_py() or "" for x in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(F.col("doc_id").cast("long")), F.lit(0)) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return batches(source, rate, "doc_id long, held_out boolean, score double, predicted int")


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(docs, labels)
    text = docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            yield batch if model is None else batch.filter(pa.array(scorer.scores(x.as_py() or "" for x in batch.column(text)) < threshold))

    return batches(docs, keep, docs.schema)
