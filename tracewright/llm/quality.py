"""Quality rules: a document's character classes and common words against those of its language.

References are summed over all documents of a language: a histogram of character classes, and the ``COMMON`` most
frequent words with the share of all others. A document is rejected where the Jensen-Shannon distance (base 2) of
either histogram to its language's exceeds ``floor + slack / sqrt(n_words)``: the second term allows for what short
texts differ by chance. Documents under ``min_words`` words aren't judged by distance (the length guard), nor are any
where no reference exists. Plain counts (symbols, repeated lines and words) come with the verdict.

Every language has its own reference, of however few words: a document is part of it, so what the two differ by by
chance is never more than against a reference without end. Copies of a text count once in it. A document without a
language (null or empty) has no reference, so it is judged by its counts alone.

Defined results: a null text has no words; an empty text fails the length rule; a null or empty language has no reference;
ties between common words go to the smaller word; repeated rows give repeated results; a very long text is measured
whole, but by parts: in one longer than a part windows and lines are told apart by 64-bit hashes, n of which are
wrong somewhere with a chance of n^2 / 2^65; other columns are kept by ``filter_quality`` and ignored by ``judge``; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.common import batches, cut, fresh, mix, written

COMMON = 40
#: References are sent to tasks up to this number; more of them are joined.
MAX_SENT_LANGUAGES = 1000
#: Hashes of the texts that have copies are sent to tasks up to this number; beyond it all texts are shuffled to find copies.
MAX_SENT_HASHES = 1_000_000
#: A task's word counts are passed on when it holds so many different words.
FLUSH_WORDS = 100_000
#: Of a text longer than a part so many different windows or lines are told apart at a time.
HELD_KEYS = 4_000_000
#: A task forgets the texts that it has seen when they are so many.
SEEN_TEXTS = 100_000
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower and upper case, digits, symbols, blanks, line breaks, other ASCII, other characters; the rest of a character's bytes don't count.
_LOWER, _UPPER, _DIGIT, _SYMBOL, _BLANK_CLASS, _BREAK, _OTHER, _BEYOND, _REST = range(9)
CLASSES = 8
_BLANK_CLASSES = [_BLANK_CLASS, _BREAK]


@dataclass(frozen=True)
class Limits:
    """Distances above ``floor + slack / sqrt(n_words)`` reject; ``min_words`` is the length guard."""

    min_words: int = 50
    class_floor: float = 0.15
    class_slack: float = 1.0
    word_floor: float = 0.22
    word_slack: float = 1.3
    max_repeat_percent: int = 50


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.int64)
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[list(SYMBOLS)] = _SYMBOL
    table[[0x20, 0x09]] = _BLANK_CLASS
    table[0x0A:0x0E] = _BREAK
    table[0x80:0xC0] = _REST
    table[0xC0:] = _BEYOND
    return table


_CLASS_OF = _class_table()
_NOT_BLANK = re.compile(rb"[^\x20\x09-\x0D]")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Texts are taken in parts of about so many bytes.
_PART = 1 << 20


def parts_of(raw: bytes | memoryview) -> Iterator[bytes]:
    """A text in parts that end at white space, so that a very long one is never a list of words as a whole."""
    at = 0
    while len(raw) - at > _PART and (found := _BLANK.search(raw, at + _PART)):
        yield bytes(raw[at : found.start()])
        at = found.start()
    yield bytes(raw[at:])


def class_histogram(raw: bytes | memoryview) -> np.ndarray:
    found = np.zeros(CLASSES + 1, np.int64)
    for at in range(0, len(raw), _PART):
        found += np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8, min(_PART, len(raw) - at), at)], minlength=CLASSES + 1)
    return found[:CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions, 0 to 1."""
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / mean), 0).sum() + np.where(q > 0, q * np.log2(q / mean), 0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) < 1 << 20:
        windows = ids[:-2] << 40 | ids[1:-1] << 20 | ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] << 31 | ids[1:], return_inverse=True)
        windows = pairs[:-1] << 31 | ids[2:]
    _, kind, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[kind] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    with_word = [x for x in lines if x.split()]
    return len(with_word) - len(set(with_word))


class Keys:
    """Numbers of 64 bits met one array after another, each held twice at most: in bounded memory those that come again, and how many differ."""

    def __init__(self) -> None:
        self.held, self.new, self.waiting = np.zeros(0, np.uint64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.waiting += len(keys)
        if self.waiting > max(_PART, len(self.held)):
            self.pack()

    def pack(self) -> None:
        found, n = np.unique(np.concatenate([self.held, *self.new]), return_counts=True)
        self.held, self.new, self.waiting = np.repeat(found, np.minimum(n, 2)), [], 0

    def again(self) -> np.ndarray:
        self.pack()
        return self.held[1:][self.held[1:] == self.held[:-1]]

    def different(self) -> int:
        self.pack()
        return len(self.held) - int((self.held[1:] == self.held[:-1]).sum())


def _turns(n: int) -> int:
    """In how many turns so many keys are told apart; a turn takes those that leave its number when divided by this."""
    return max(1, -(-n // HELD_KEYS))


def _window_keys(raw: memoryview) -> Iterator[np.ndarray]:
    """A number for each window of three words, part by part; equal windows have equal ones."""
    left = np.zeros(0, np.uint64)
    for part in parts_of(raw):
        words = part.split()
        ids = np.concatenate([left, np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)])
        left = ids[-2:]
        if len(ids) > 2:
            yield mix(mix(mix(ids[:-2]) + ids[1:-1]) + ids[2:])


def long_repeated_words(raw: memoryview, n: int) -> int:
    """``repeated_words`` of a text of n words, by parts: windows are told apart in turns of bounded memory, besides a byte a word."""
    if n < 4:
        return 0
    covered = np.zeros(n, dtype=bool)
    turns = np.uint64(_turns(n))
    again = np.zeros(0, np.uint64)
    for turn in range(int(turns) + 1):  # marks the windows of the turn before while it takes its own
        keys, at = Keys(), 0
        for windows in _window_keys(raw):
            of = windows % turns
            if len(again):
                where = at + np.flatnonzero(of == turn - 1)
                of_them = windows[where - at]
                where = where[again[np.minimum(np.searchsorted(again, of_them), len(again) - 1)] == of_them]
                for i in range(3):
                    covered[where + i] = True
            if turn < turns:
                keys.add(windows[of == turn])
            at += len(windows)
        again = keys.again()
    return int(covered.sum())


def _line_key(line: memoryview) -> int:
    if len(line) <= _PART:
        return hash(bytes(line))
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _line_keys(raw: memoryview) -> Iterator[np.ndarray]:
    """A number for each line with a word, some lines at a time; equal lines have equal ones."""
    start, found = 0, []
    for at in range(0, len(raw), _PART):
        for end in (at + np.flatnonzero(np.frombuffer(raw, np.uint8, min(_PART, len(raw) - at), at) == 10)).tolist():
            if _NOT_BLANK.search(raw, start, end):
                found.append(_line_key(raw[start:end]))
            start = end + 1
        yield np.array(found, np.int64).view(np.uint64)
        found = []
    if _NOT_BLANK.search(raw, start):
        yield np.array([_line_key(raw[start:])], np.int64).view(np.uint64)


def long_repeated_lines(raw: memoryview) -> int:
    """``repeated_lines`` by parts: lines are told apart in turns of bounded memory."""
    n = sum(map(len, _line_keys(raw)))
    turns = _turns(n)
    different = 0
    for turn in range(turns):
        keys = Keys()
        for lines in _line_keys(raw):
            keys.add(lines[mix(lines) % np.uint64(turns) == turn])
        different += keys.different()
    return n - different


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and character classes of (lang, raw), by language."""
    words: dict[str, Counter] = {}
    totals: Counter = Counter()

    def held() -> Iterator[pa.RecordBatch]:
        out = [(lang, w.decode(), n) for lang, own in words.items() for w, n in own.items() if w.isalpha() or not w.isascii() and w.decode().isalpha()]
        out += [(lang, f" {kind}", n) for (lang, kind), n in totals.items()]
        words.clear()
        totals.clear()
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 50_000]), (pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"])

    for batch in rows:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_py()
            own = words.setdefault(lang, Counter())
            n = 0
            for part in parts_of(raw):
                found = part.lower().split()
                own.update(found)
                n += len(found)
            totals[lang, "words"] += n
            for kind, n in enumerate(class_histogram(raw).tolist()):
                totals[lang, kind] += n
        if len(totals) + sum(map(len, words.values())) > FLUSH_WORDS:
            yield from held()
    yield from held()


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of the different texts of each language; texts without copies are counted where they lie."""
    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("raw"))
    source = source.filter("lang <> '' and length(raw) > 0").withColumn("hash", F.xxhash64("lang", "raw"))
    repeated = cut(source.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    # at most MAX_SENT_HASHES numbers
    few = repeated.count() <= MAX_SENT_HASHES
    twice = np.sort(repeated.toArrow().column(0).to_numpy()) if few else None

    def is_repeated(batch: pa.RecordBatch) -> np.ndarray:
        return np.isin(batch.column(2).to_numpy(), twice)

    def alone(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batch.filter(pa.array(~is_repeated(batch))) for batch in rows if batch.num_rows)

    def copies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that may be copies, those of one task once."""
        seen: set[bytes] = set()
        for batch in rows:
            if twice is not None and batch.num_rows:
                batch = batch.filter(pa.array(is_repeated(batch)))
            new = []
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = hashlib.blake2b(lang.encode() + b"\n", digest_size=16)
                key.update(raw)
                digest = key.digest()
                new.append(digest not in seen)
                seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(seen) > SEEN_TEXTS:
                seen.clear()

    def once(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first() -> Iterator[pa.RecordBatch]:
            seen: set[tuple] = set()  # the different texts of one hash
            last = None
            for batch in rows:
                new = []
                for key in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key[0] != last:
                        seen.clear()
                        last = key[0]
                    new.append(key not in seen)
                    seen.add(key)
                yield batch.filter(pa.array(new, pa.bool_()))

        return _count(first())

    shape = "lang string, key string, n long"
    dealt = batches(source, copies, "lang string, raw binary, hash long").repartition("hash").sortWithinPartitions("hash")
    counts = batches(dealt, once, shape)
    if twice is not None:
        counts = counts.unionByName(batches(source, alone, shape))
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _reference(items: list) -> Reference | None:
    """Class shares, common words, their shares with the others' last, from pairs of key and n; None without words."""
    own = dict(sorted(((r["key"], r["n"]) for r in items), key=lambda x: (-x[1], x[0])))
    total = own.get(" words", 0)
    if not total:
        return None
    classes = np.array([own.get(f" {k}", 0) for k in range(CLASSES)], dtype=float)
    common = [k for k in own if not k.startswith(" ")]
    shares = np.array([own[k] for k in common] + [0], dtype=float)
    shares[-1] = max(0.0, total - shares.sum())
    return classes / classes.sum(), {k.encode(): i for i, k in enumerate(common)}, shares / total


def references(docs: DataFrame) -> DataFrame:
    """Per language: lang, items (key and n of its common words, its classes and its words' number)."""
    counts = written(_word_counts(docs), "quality-words")
    words = counts.filter(~F.col("key").startswith(" "))
    # words below the class of counts that a language's common ones end in can't be among them; so few words of a language meet
    size_class = F.floor(F.log2("n") * 8)
    above = F.sum("held").over(Window.partitionBy("lang").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = words.groupBy("lang", size_class.alias("class")).agg(F.count("*").alias("held")).withColumn("above", F.coalesce(above, F.lit(0)))
    least = cut(sizes.filter(F.col("above") < COMMON).groupBy("lang").agg(F.min("class").alias("least")))  # a row a language
    if least.count() <= MAX_SENT_LANGUAGES:
        least = F.broadcast(least)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = words.join(least, "lang").filter(size_class >= F.col("least")).withColumn("rank", rank).filter(F.col("rank") <= COMMON).select("lang", "key", "n")
    found = top.unionByName(counts.filter(F.col("key").startswith(" ")))  # at most COMMON + CLASSES + 1 rows a language
    return cut(found.groupBy("lang").agg(F.collect_list(F.struct("key", "n")).alias("items")))


def _attached(docs: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch, list], list[Reference | None]]]:
    """``docs`` and what gives its batches' references by their languages; where there are many, each row's own is added as the last column."""
    found = references(docs)
    if found.count() <= MAX_SENT_LANGUAGES:
        known = {r["lang"]: _reference(r["items"]) for r in found.collect()}
        return docs, lambda batch, langs: [known.get(x) for x in langs]

    def own(batch: pa.RecordBatch, langs: list) -> list[Reference | None]:
        first = {lang: i for i, lang in enumerate(langs)}
        items = batch.column(batch.num_columns - 1)
        made = {lang: _reference(items[i].as_py() or ()) for lang, i in first.items()}
        return [made[x] for x in langs]

    lang, column = fresh(docs, "_language"), fresh(docs, "_reference")
    found = found.select(F.col("lang").alias(lang), F.col("items").alias(column))
    return docs.join(found, docs["lang"].cast("string") == found[lang], "left").select(*(docs[x] for x in docs.columns), column), own


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _measured(text: pa.Scalar, reference: Reference | None, limits: Limits) -> tuple:
    """Values of ``COUNTS`` for a document (binary) and its reference; a text longer than a part is never copied or split as a whole."""
    whole = text.as_buffer()
    raw: bytes | memoryview = memoryview(whole).toreadonly() if whole else b""
    classes = class_histogram(raw)
    if len(raw) <= _PART:
        raw = bytes(raw)
        words = raw.split()
        n = len(words)
        repeats, lines = repeated_words(words), repeated_lines(raw)
    else:
        n = sum(len(part.split()) for part in parts_of(raw))
        repeats, lines = long_repeated_words(raw, n), long_repeated_lines(raw)
    failed = n < limits.min_words or 100 * repeats > limits.max_repeat_percent * n
    by_class = by_word = None
    if n >= max(1, limits.min_words) and reference is not None:
        shares, common, word_shares = reference
        by_class = js_distance(classes / classes.sum(), shares)
        own = np.zeros(len(word_shares))
        for part in parts_of(raw):
            own += np.bincount([i for i in map(common.get, part.lower().split()) if i is not None], minlength=len(word_shares))
        own[-1] = n - own[:-1].sum()
        by_word = js_distance(own / n, word_shares)
    distant = by_class is not None and (by_class > limits.class_floor + limits.class_slack / n**0.5 or by_word > limits.word_floor + limits.word_slack / n**0.5)
    chars = int(classes.sum()) - int(classes[_BLANK_CLASSES].sum())
    return n, chars, int(classes[_SYMBOL]), lines, repeats, by_class, by_word, failed, not (failed or distant)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document: doc_id, the counts, both distances (null where not judged), base_failed, kept."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    given, of = _attached(source)

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        names = ["doc_id", *(x.split()[0] for x in COUNTS.split(", "))]
        for batch in rows:
            if batch.num_rows:
                out = [_measured(x, own, limits) for x, own in zip(batch.column(2).cast(pa.binary()), of(batch, batch.column(1).to_pylist()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names)

    return batches(given, measure, "doc_id long, " + COUNTS)


def filter_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept documents with all their columns; verdicts are made where the rows lie, unless there are very many languages."""
    given, of = _attached(docs)
    names, lang, text = docs.columns, docs.columns.index("lang"), docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            known = of(batch, batch.column(lang).cast(pa.string()).to_pylist())
            kept = [_measured(x, own, limits)[-1] for x, own in zip(batch.column(text).cast(pa.binary()), known)]
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    return batches(given, keep, docs.schema)
