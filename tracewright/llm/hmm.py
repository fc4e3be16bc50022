"""Hidden Markov language model, trained by Baum-Welch over all training texts and scored by the scaled forward recursion.

A text is its words (what lies between ASCII white space, A-Z lower-cased) and an end token. The model's symbols are the
end token, the ``HEAD`` most frequent words of the training texts, and ``CLASSES`` classes that every other word belongs
to by the hash of its last three bytes. A hidden state emits a symbol; a class's word then has the smoothed relative
frequency (c + 0.1) / (C + 0.1 (V + 1)) among the class's training words, an unknown one c = 0. So a text's probability
is that of its symbols, summed over all state sequences, times that of its rare words given their classes.

What tasks hold is bounded by ``HEAD + CLASSES``; counts of rare words stay distributed and meet the texts in a join.
Words outside the head that are more than one in ``COMMON_SHARE`` of all tokens, held-out texts' too (there may be such
that training never saw), aren't joined but sent to tasks, so no word's rows can fill a task of the join.
Training starts from a bounded sample of ``SAMPLE`` texts of ``SAMPLE_TOKENS`` tokens at most; each re-estimation then
sums expected counts over all training texts: tasks add up their own, a shuffle by symbol adds up the tasks'. They end
when one has raised the training texts' log-likelihood by less than ``TOLERANCE`` a token.

Defined results: a null text counts as empty; an empty text is the end token alone; a null doc_id is a training row;
every row is scored on its own, also repeated ones; a very long text passes the recursions in segments, with the same
results; other columns are ignored; an empty table gives an empty table, and without training rows all counts are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.llm.common import batches, by_hash, fitting, likely_sample, written
from tracewright.llm.quality import parts_of

STATES, SAMPLE, SAMPLE_TOKENS, SAMPLE_ROUNDS = 8, 600, 1_000_000, 12
#: Re-estimation ends where the log-likelihood (natural logarithm) of a training token rises by less.
TOLERANCE = 0.01
HEAD, CLASSES = 32_000, 512
#: Mass of the corpus-wide distribution in each state's emissions, in tokens.
PRIOR = 50.0
#: Texts pass through the recursions together, about so many tokens at a time.
GROUP_TOKENS = 400_000
#: The recursions keep values of about so many tokens; longer groups pass in segments.
SEGMENT_TOKENS = 1_000_000
#: Likelihoods are scaled every so many tokens: a token's factor is above 1e-36, so that doubles hold their product.
SCALED = 8
#: Texts of about so many tokens (and 100 more for each text) are grouped by their lengths.
WINDOW_TOKENS = 8_000_000
#: Texts are taken apart into words about so many bytes at a time.
CHUNK_BYTES = 4 << 20
FLUSH_WORDS = 100_000
#: Outside the head, words that are more than one in so many of all tokens are sent to tasks: fewer than this number.
COMMON_SHARE = 50_000
ADDED = 0.1
END = b"\n"


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is divisible by 10."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


#: What a byte does to a CRC-32.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def classes_of(words: pa.Array) -> np.ndarray:
    """``word_class`` of each of binary words."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        some = np.diff(ends) >= back
        crc[some] = _CRC[(crc[some] ^ raw[ends[1:][some] - back]) & 0xFF] ^ (crc[some] >> np.uint32(8))
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(CLASSES)).astype(np.int64)


@dataclass
class Symbols:
    """Numbers of the head's words (the end token has 0), counts of all symbols, the classes' words, and training counts of common words outside the head."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int
    common: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def all_words(self) -> float:
        """What a word's smoothed count is divided by."""
        return self.total + ADDED * (self.distinct + 1)

    @property
    def class_totals(self) -> np.ndarray:
        """What the smoothed count of a word of a class is divided by."""
        return self.counts[len(self.numbers) + 1 :] + ADDED * (self.class_words + 1)

    @property
    def share(self) -> np.ndarray:
        return (self.counts + ADDED) / (self.counts + ADDED).sum()


def chunks(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, pa.Array]]:
    """The words of a batch's texts in turns of bounded size: the rows of their parts, the words of each part, and the words, lower-cased, one after another."""

    def words(rows: list[int], parts: list[bytes]) -> tuple[list[int], np.ndarray, pa.Array]:
        raw = np.frombuffer(b"\n".join([b"", *parts, b""]).lower(), np.uint8)
        inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[0::2], edges[1::2]
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        bounds = np.cumsum([0, *(len(x) + 1 for x in parts)])
        return rows, np.diff(np.searchsorted(begin, bounds)), found

    rows, parts, size = [], [], 0
    for i, raw in enumerate(column):
        for part in parts_of(memoryview(raw.as_buffer())):
            if parts and size + len(part) > CHUNK_BYTES:
                yield words(rows, parts)
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield words(rows, parts)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all training texts (the end token is among them), every: over all texts. texts: held_out, raw."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n", "every"]
        found: list[pa.Table] = []
        ends = {False: 0, True: 0}

        def held() -> pa.Table:
            return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum"), ("every", "sum")]).select(["word", "n_sum", "every_sum"]).rename_columns(names)

        for batch in rows:
            out = batch.column(0).to_numpy(zero_copy_only=False)
            ends[True] += int(out.sum())
            ends[False] += int((~out).sum())
            for owner, n_words, words in chunks(batch.column(1)):
                coded = words.dictionary_encode()
                codes, size = coded.indices.to_numpy(), len(coded.dictionary)
                every = np.bincount(codes, minlength=size)
                n = every - np.bincount(codes[np.repeat(out[owner], n_words)], minlength=size)
                found.append(pa.table([coded.dictionary, n, every], names))
                if sum(map(len, found)) > 4 * FLUSH_WORDS or sum(x.nbytes for x in found) > 16 * CHUNK_BYTES:
                    found = [held()]
                    if len(found[0]) > FLUSH_WORDS or found[0].nbytes > 8 * CHUNK_BYTES:
                        yield from found.pop().to_batches(50_000)
        found.append(pa.table([pa.array([END], pa.binary()), pa.array([ends[False]]), pa.array([sum(ends.values())])], names))
        yield from held().to_batches(50_000)

    return batches(texts.select("held_out", "raw"), count, "word binary, n long, every long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _class_of(word: Column) -> Column:
    return F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(CLASSES)).cast("int")


def symbols(counts: DataFrame, head: int = HEAD) -> Symbols:
    """The symbols from the words' counts."""
    sums = (F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0)))
    total, distinct, ends, tokens = counts.agg(*sums).first()
    # words below the class of counts that the head ends in can't be in it; so tasks send few words each
    words_only = counts.filter((F.col("word") != F.lit(END)) & (F.col("n") > 0))
    size_class = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(words_only.groupBy(size_class.alias("c")).count().collect(), reverse=True):  # a row for each class, 8 a doubling
        least, held = r["c"], held + r["count"]
        if held >= head:
            break
    top = words_only.filter(size_class >= least).orderBy(F.desc("n"), "word").limit(head).collect()  # at most HEAD rows
    numbers = {bytes(r["word"]): i for i, r in enumerate(top, 1)}
    all_of = np.zeros(CLASSES)
    words = np.zeros(CLASSES)
    for r in words_only.groupBy(_class_of(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        all_of[r["k"]], words[r["k"]] = r["n"], r["v"]
    for r in top:
        k = word_class(bytes(r["word"]))
        all_of[k] -= r["n"]
        words[k] -= 1
    often = counts.filter((F.col("word") != F.lit(END)) & (F.col("every") * COMMON_SHARE > tokens)).collect()  # fewer than COMMON_SHARE rows
    common = {bytes(r["word"]): r["n"] for r in often if bytes(r["word"]) not in numbers}
    return Symbols(numbers, np.concatenate([[ends], [r["n"] for r in top], all_of]), words, total, distinct, common)


CODED = "row_id long, doc_id long, held_out boolean, symbols binary, n_known long, base double, likely double, rare array<binary>"


def encoded(texts: DataFrame, known: Symbols) -> DataFrame:
    """Every text as symbols (binary, unsigned 16-bit), with what the head's and common words outside it give, and its rare words, part by part."""
    first = len(known.numbers) + 1
    totals = known.class_totals
    n = np.array(list(known.common.values()), float)
    classes = classes_of(pa.array(list(known.common), pa.binary()))
    # of the end token and the head's words, then of common words
    given_words = pa.array([*known.numbers, *known.common], pa.binary())
    symbol = np.concatenate([np.arange(first), first + classes]).astype(np.uint16)
    n_known = np.concatenate([known.counts[:first] > 0, n > 0]).astype(float)
    base = np.log10((np.concatenate([known.counts[:first], n]) + ADDED) / known.all_words)
    likely = np.concatenate([np.zeros(first), np.log10((n + ADDED) / totals[classes])])

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CODED.split(", ")]
        for batch in rows:
            n = len(batch)
            symbols, lengths, given, rare = [], np.zeros(n, np.int64), np.zeros((3, n)), [[] for _ in range(n)]
            for owner, n_words, words in chunks(batch.column(3)):
                found = pc.index_in(words, given_words)
                left = found.is_null().to_numpy(zero_copy_only=False)
                others = words.filter(pa.array(left))
                place = found.fill_null(-1).to_numpy()[~left] + 1
                ids = np.empty(len(words), np.uint16)
                ids[~left] = symbol[place]
                ids[left] = first + classes_of(others)
                symbols.append(ids)
                lengths += np.bincount(owner, weights=n_words, minlength=n).astype(np.int64)
                of_row = np.repeat(owner, n_words)[~left]
                for total, x in zip(given, (n_known, base, likely)):
                    total += np.bincount(of_row, weights=x[place], minlength=n)
                offsets = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], np.cumsum(n_words)])].astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), others), b" ")
                for i, some, part in zip(owner, np.diff(offsets), joined.to_pylist()):
                    if some:
                        rare[i].append(part)
            # the end token's 0 after each text's symbols
            ends = np.cumsum(lengths + 1)
            ids = np.zeros(int(ends[-1]) if n else 0, "<u2")
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = np.concatenate(symbols) if symbols else []
            offsets = np.zeros(n + 1, np.int32)
            offsets[1:] = 2 * ends
            text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            sums = pa.array((given[0] + n_known[0]).astype(np.int64)), pa.array(given[1] + base[0]), pa.array(given[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], text, *sums, pa.array(rare, pa.list_(pa.binary()))], names)

    source = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "held_out", "raw")
    return batches(source, encode, CODED)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


class Group:
    """Texts laid out by position: the first tokens of all, longest text first, then the second ones, and so on."""

    def __init__(self, texts: list[np.ndarray]):
        length = np.array([len(x) for x in texts])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        self.active = len(texts) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.symbols = np.empty(len(place), texts[0].dtype)
        self.symbols[self.at[place] + np.repeat(np.arange(len(texts)), length)] = np.concatenate([texts[i] for i in self.order])

    def segments(self) -> list[tuple[int, int]]:
        """Ranges of positions with about ``SEGMENT_TOKENS`` tokens each."""
        bounds = [0]
        while bounds[-1] < len(self.active):
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(self.at, self.at[bounds[-1]] + SEGMENT_TOKENS, side="right")) - 1))
        return list(zip(bounds, bounds[1:]))

    def forward(self, model: Hmm, first: int, last: int, now: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values and scales by token, and emissions over scales, for positions from first up to last; ``now``: the values before."""
        base = self.at[first]
        emission = model.emit.take(self.symbols[base : self.at[last]], axis=0)
        values = np.empty_like(emission)
        scales = np.empty(len(emission), emission.dtype)
        # a product with it has a row's sum in every column, so that whole blocks are divided by each other
        ones = np.ones_like(model.move)
        for t in range(first, last):
            n = self.active[t]
            a, b = self.at[t] - base, self.at[t] - base + n
            emitted, before = emission[a:b], now
            now = values[a:b]
            if before is None:
                np.multiply(emitted, model.start, out=now)
            else:
                np.matmul(before[:n], model.move, out=now)
                now *= emitted
            scale = now @ ones
            now /= scale
            emitted /= scale
            scales[a:b] = scale[:, 0]
        return values, scales, emission

    def log_likelihood(self, model: Hmm) -> np.ndarray:
        """Natural logarithm of each text's probability, in the given order."""
        total = np.zeros(len(self.order))
        ends = np.append(self.active[1:], 0)  # texts that go on after each position
        now = None
        for t, (n, left) in enumerate(zip(self.active.tolist(), ends.tolist())):
            emitted = model.emit.take(self.symbols[self.at[t] : self.at[t + 1]], axis=0)
            if now is None:
                emitted *= model.start
            else:
                emitted *= now[:n] @ model.move
            now = emitted
            if t % SCALED == SCALED - 1:
                scale = now.sum(axis=1)
                total[:n] += np.log(scale)
                now /= scale[:, None]
            if left < n:
                total[left:n] += np.log(now[left:].sum(axis=1))
        out = np.empty(len(self.order))
        out[self.order] = total
        return out

    def expected(self, model: Hmm, counts: np.ndarray) -> float:
        """Add expected counts: rows of ``counts`` are symbols' emissions by state, then transitions from each state, then starts. Returns the log-likelihood."""
        states, size = model.move.shape[0], model.emit.shape[0]
        parts = self.segments()
        before: list[np.ndarray | None] = [None]
        for first, last in parts[:-1]:  # a segment's forward values are made again when the backward ones come to it
            before.append(self.forward(model, first, last, before[-1])[0][self.at[last - 1] - self.at[first] :].copy())
        moves = np.zeros((states, states))
        back = np.ascontiguousarray(model.move.T)
        likely, after = 0.0, None
        for (first, last), start in zip(reversed(parts), reversed(before)):
            values, scales, emission = self.forward(model, first, last, start)
            likely += float(np.log(scales).sum(dtype=float))
            base = self.at[first]
            for t in range(last - 1, first - 1, -1):
                a, b = self.at[t] - base, self.at[t + 1] - base
                # emission times backward value over scale, as the step before needs it; the backward value of a text's end is 1
                here = emission[a:b]
                if after is not None:
                    m = len(after)
                    value = values[a : a + m]
                    backward = after @ back
                    moves += value.T @ after
                    value *= backward
                    here[:m] *= backward
                after = here
            where = self.symbols[base : self.at[last]].astype(np.intp)
            by_state = np.empty(values.shape[::-1])
            for i in range(0, len(values), 4096):  # blocks that the processor's cache holds
                by_state[:, i : i + 4096] = values[i : i + 4096].T
            for s in range(states):
                counts[:size, s] += np.bincount(where, weights=by_state[s], minlength=size)
            if first == 0:
                counts[size + states] += values[: self.active[0]].sum(axis=0)
        counts[size : size + states] += moves * model.move
        return likely


def groups(texts: list[np.ndarray]) -> Iterator[tuple[list[int], Group]]:
    """Texts in groups of alike length and bounded size, with their places in the list."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    some: list[int] = []
    size = 0
    for i in order:
        if some and size + len(texts[i]) > GROUP_TOKENS:
            yield some, Group([texts[j] for j in some])
            some, size = [], 0
        some.append(i)
        size += len(texts[i])
    if some:
        yield some, Group([texts[j] for j in some])


def estimated(counts: np.ndarray, share: np.ndarray, states: int) -> Hmm:
    """The model of expected counts; each state's emissions hold ``PRIOR`` tokens of the corpus-wide distribution."""
    size = len(share)
    emit = counts[:size] + PRIOR * share[:, None]
    move = counts[size : size + states] + 0.1
    start = counts[size + states] + 0.1
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(sample: list[np.ndarray], known: Symbols, states: int = STATES, rounds: int = SAMPLE_ROUNDS) -> Hmm:
    """The model that training starts from: states that tend to last, told apart on a few texts."""
    rng = np.random.default_rng(7)
    share = known.share
    emit = share[:, None] * rng.uniform(0.5, 1.5, (known.size, states))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / max(1, states - 1)), emit / emit.sum(axis=0))
    np.fill_diagonal(model.move, 0.95 if states > 1 else 1.0)
    for _ in range(rounds if sample else 0):
        counts = np.zeros((known.size + states + 1, states))
        for _, group in groups(sample):
            group.expected(model, counts)
        model = estimated(counts, share, states)
    return model


def windows(rows: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches by bounded numbers of tokens, with their texts: the more of them, the more texts of a length pass together."""
    held: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in rows:
        own = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(batch.schema.get_field_index(name))]
        more = sum(map(len, own)) + 100 * len(own)
        if held and size + more > WINDOW_TOKENS:
            yield held, texts
            held, texts, size = [], [], 0
        held.append(batch)
        texts += own
        size += more
    if held:
        yield held, texts


def baum_welch(coded: DataFrame, model: Hmm, known: Symbols) -> tuple[Hmm, float]:
    """One re-estimation over all training texts, and their log-likelihood by the model before it."""
    states = len(model.start)
    rows_of = known.size + states + 1
    small = Hmm(model.start.astype(np.float32), model.move.astype(np.float32), model.emit.astype(np.float32))

    def expect(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((rows_of + 1, states))
        for _, texts in windows(rows, "symbols"):
            for _, group in groups(texts):
                counts[rows_of, 0] += group.expected(small, counts)
        some = np.flatnonzero(counts.any(axis=1))
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(counts[part, s]) for s in range(states))], ["row", *(f"s{s}" for s in range(states))])

    shape = "row long, " + ", ".join(f"s{s} double" for s in range(states))
    summed = batches(coded.filter("not held_out").select("symbols"), expect, shape).groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states)))
    found = summed.toArrow()  # at most HEAD + CLASSES + STATES + 3 rows
    counts = np.zeros((rows_of + 1, states))
    counts[found.column("row").to_numpy()] = np.stack([found.column(f"s{s}").to_numpy() for s in range(states)], axis=1)
    return estimated(counts[:-1], known.share, states), float(counts[-1, 0])


def trained(coded: DataFrame, known: Symbols, states: int = STATES, tolerance: float = TOLERANCE) -> tuple[Hmm, list[float]]:
    """The model, and the log-likelihoods of a training token before each re-estimation."""
    training = coded.filter("not held_out").select("doc_id", "row_id", "symbols")
    near = likely_sample(training, "doc_id", SAMPLE, int(known.counts[0]))  # as many end tokens as training rows
    order = [*by_hash("doc_id"), "row_id"]
    first = near.orderBy(*order).limit(SAMPLE).select("row_id", (F.octet_length("symbols") / 2).cast("long").alias("n")).collect()  # at most SAMPLE rows
    chosen = [first[i]["row_id"] for i in fitting([r["n"] for r in first], SAMPLE_TOKENS)]
    picked = near.filter(F.col("row_id").isin(chosen)).orderBy(*order).select("symbols").toArrow()
    model = first_model([np.frombuffer(x.as_buffer(), "<u2") for x in picked.column(0).combine_chunks()] if picked.num_rows else [], known, states)
    likely: list[float] = []
    while known.total and (len(likely) < 2 or likely[-1] - likely[-2] >= tolerance):
        model, total = baum_welch(coded, model, known)
        likely.append(total / known.total)
    return model, likely


def score(docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score; log10."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    counts = written(word_counts(texts), "lm-words")
    known = symbols(counts, head)
    coded = written(encoded(texts, known), "lm-symbols")
    model, _ = trained(coded, known, states, tolerance)

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in windows(rows, "symbols"):
            likely = np.zeros(len(texts))
            for some, group in groups(texts):
                likely[some] = group.log_likelihood(model) / np.log(10)
            n_tokens, at = np.array([len(x) for x in texts], np.int64), 0
            for batch in held:
                own = slice(at, at + len(batch))
                at += len(batch)
                values = [pa.array(n_tokens[own]), *batch.columns[4:6], pa.array(likely[own] + batch.column(6).to_numpy())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *values], ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "likely"])

    rated = batches(coded.drop("rare"), rate, "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, likely double")
    class_total = F.array(*(F.lit(float(x)) for x in known.class_totals))
    rare = coded.select("row_id", F.explode("rare").alias("part")).select("row_id", F.explode(F.split(F.col("part").cast("string"), " ")).alias("word")).withColumn("word", F.col("word").cast("binary"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    of_rare = met.groupBy("row_id").agg(
        F.sum(F.log10((F.col("c") + ADDED) / F.lit(known.all_words))).alias("rare_base"),
        F.sum(F.log10((F.col("c") + ADDED) / F.get(class_total, _class_of(F.col("word"))))).alias("rare_likely"),
        F.count_if(F.col("c") > 0).alias("rare_known"),
    )
    zero = F.lit(0)
    return rated.join(of_rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(int(known.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("likely") + F.coalesce("rare_likely", zero)).alias("score"),
    )
