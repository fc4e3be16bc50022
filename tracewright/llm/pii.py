"""Personal data: patterns, and terms that the corpus shows to reveal a protected entity.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that plain patterns find, and what
several of them share: an address's host, an IP's first two parts, a card's first six digits (its issuer), a phone's
first four (country and area). A term that stands near an entity may reveal it, or the group that it belongs to,
although the entity itself is masked. How strongly is estimated from the corpus: with p(e), p(t) and p(e, t) the shares
of documents that hold the entity, the term, and both close together,

    disclosure(t, e) = PMI(t, e) / IC(e) = log(p(e, t) / (p(e) p(t))) / -log p(e)

which is 0 for an independent term and 1 for one that stands nowhere but beside the entity. A term discloses where
this is at least ``threshold`` and at least ``min_support`` different surroundings of the entity hold it: copies of one
passage are one surrounding. In the window of an entity that it discloses, or whose group it does, such a term becomes a
span of kind ``term`` and is removed or, at the lower half of the scale, generalised to its shape; entities are replaced
by their kind.

Defined results: a null text counts as empty and a null stays null when sanitised; terms are letters-only words of
three letters or more, lower-cased; repeated rows count as documents of their own but not as surroundings; a very long
text is taken whole, in time that grows with its length; other columns are kept by ``sanitise`` and ignored by ``find``;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches, cut, fresh, written

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as its surroundings.
WINDOW = 8
#: Disclosing pairs are sent to tasks up to this number; more of them are joined.
MAX_SENT_PAIRS = 200_000
#: A task passes on so many mentions at a time.
MENTIONS = 50_000
#: A task's term counts are passed on when it holds so many different terms.
FLUSH_TERMS = 100_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: a later begin in the run would need the same dot behind it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM_EDGES = ".,;:!?\"'()[]{}<>|*#$%&"


@dataclass(frozen=True)
class Rules:
    min_support: int = 3
    threshold: float = 0.5


Span = tuple[str, int, int]


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long runs of letters cost no more than their length."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Entities by kind, each kind leftmost and without overlap; matches that fail a kind's test are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def entity_key(text: str, span: Span) -> str:
    """An entity whatever its punctuation: its kind and its digits, or its lower-cased address."""
    kind, a, b = span
    own = text[a:b]
    return f"{kind}:{own.lower() if kind in ('email', 'ip') else ''.join(_DIGIT.findall(own))}"


def group_key(key: str) -> str:
    """What an entity shares with others of its kind: host, first two parts, first six or four digits."""
    kind, _, own = key.partition(":")
    if kind == "email":
        return f"host:{own.rpartition('@')[2]}"
    if kind == "ip":
        return f"net:{'.'.join(own.split('.')[:2])}"
    return f"{'issuer' if kind == 'card' else 'area'}:{own[: 6 if kind == 'card' else 4]}"


def _term(word: str) -> str | None:
    own = word.strip(_TERM_EDGES)
    return own.lower() if len(own) >= 3 and own.isalpha() and len(own.lower()) == len(own) else None


def terms(text: str) -> set[str]:
    """The different terms of a text."""
    return {found for w in set(text.encode().split()) if (found := _term(w.decode())) is not None}


class Surroundings:
    """The words of a text by place, found once, so that what stands about an entity costs no search."""

    def __init__(self, text: str, window: int = WINDOW):
        self.text, self.window = text, window
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.concatenate([[True], (code == 0x20) | (code >= 0x09) & (code <= 0x0D), [True]])
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        self.ends = np.flatnonzero(~blank[:-1] & blank[1:])

    def of(self, span: Span) -> list[tuple[str, int, int]]:
        """Terms within ``window`` words before and after an entity, (term, start, end); a word that the entity cuts counts with what lies outside."""
        _, a, b = span
        left = int(np.searchsorted(self.starts, a))
        right = int(np.searchsorted(self.ends, b, side="right"))
        near = [(int(self.starts[i]), min(a, int(self.ends[i]))) for i in range(max(0, left - self.window), left)]
        near += [(max(b, int(self.starts[i])), int(self.ends[i])) for i in range(right, min(len(self.ends), right + self.window))]
        out = []
        for start, end in near:
            word = self.text[start:end]
            if (found := _term(word)) is not None:
                start += len(word) - len(word.lstrip(_TERM_EDGES))
                out.append((found, start, start + len(found)))
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def disclosing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Pairs that disclose: entity, term, disclosure. Counts are of all documents."""

    def mentions(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = {"entity": pa.string(), "term": pa.string(), "place": pa.int64(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], list(kinds))

        out: list[tuple] = []
        for batch in rows:
            for text in batch.column(0):
                text = text.as_py()
                base = base_spans(text)
                if not base:
                    continue
                about = Surroundings(text)
                pairs: set[tuple[str, str]] = set()
                seen: set[tuple[str, int]] = set()
                for span in base:
                    near = sorted({t for t, _, _ in about.of(span)})
                    place = int.from_bytes(hashlib.blake2b(" ".join(near).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    own = entity_key(text, span)
                    for key in (own, group_key(own)):
                        if (key, place) in seen:
                            continue
                        seen.add((key, place))
                        for term in ("", *near):
                            # the document counts once for each pair, at the first place; an entity's own row needs no place
                            first = (key, term) not in pairs
                            pairs.add((key, term))
                            if first or term:
                                out.append((key, term, place if term else 0, int(first)))
                    if len(out) >= MENTIONS:
                        yield made(out)
                        out = []
        yield made(out)

    texts = _texts(docs)
    # copies of a passage first shrink to one row for each place, then places are counted
    places = batches(texts.select("text"), mentions, "entity string, term string, place long, n long").groupBy("entity", "term", "place").agg(F.sum("n").alias("n"))
    pairs = cut(places.groupBy("entity", "term").agg(F.sum("n").alias("docs"), F.count("*").alias("places")).filter((F.col("term") == "") | (F.col("places") >= rules.min_support)))
    candidates = pairs.filter("term <> ''").select("term").distinct()
    entities = pairs.filter("term = ''").select("entity", F.col("docs").alias("entity_docs"))
    total = docs.count()
    n_terms = candidates.count()
    if not n_terms:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure")).limit(0)
    wanted = frozenset(candidates.toArrow().column(0).to_pylist()) if n_terms <= MAX_SENT_PAIRS else None  # at most MAX_SENT_PAIRS words

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        counts: dict[str, int] = {}
        for batch in rows:
            for text in batch.column(0):
                found = terms(text.as_py())
                for term in found if wanted is None else wanted & found:
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) >= FLUSH_TERMS:
                    yield made()
                    counts.clear()
        yield made()

    frequency = batches(texts.select("text"), held, "term string, n long")
    if wanted is None:
        frequency = frequency.join(candidates, "term", "left_semi")
    frequency = frequency.groupBy("term").agg(F.sum("n").alias("term_docs"))
    n = F.lit(float(max(total, 2)))
    pmi = F.log(F.col("docs") * n / (F.col("entity_docs") * F.greatest("term_docs", "docs")))
    found = pairs.filter("term <> ''").join(entities, "entity").join(frequency, "term").withColumn("disclosure", pmi / F.greatest(F.log(n / F.col("entity_docs")), F.lit(1e-9)))
    return found.filter(F.col("disclosure") >= rules.threshold).select("entity", "term", "disclosure")


Known = dict[str, dict[str, float]]


def _spans(text: str, known: Known) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind; a term's carries its disclosure, an entity's 1."""
    base = base_spans(text)
    out = {span: 1.0 for span in base}
    if known and base:
        about = None
        covered = _covered(base)
        for span in base:
            key = entity_key(text, span)
            own = [x for k in (key, group_key(key)) if (x := known.get(k))]
            if own:
                about = about or Surroundings(text)
                for term, a, b in about.of(span):
                    value = max(x.get(term, -1.0) for x in own)
                    if value >= 0 and not _overlaps(covered, a, b):
                        out["term", a, b] = max(value, out.get(("term", a, b), 0.0))
    order = (*KINDS, "term")
    return sorted(((*span, value) for span, value in out.items()), key=lambda x: (x[1], order.index(x[0])))


def _covered(base: list[Span]) -> tuple[list[int], list[int]]:
    """Begins and ends of what the spans cover together."""
    begins: list[int] = []
    ends: list[int] = []
    for _, a, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _overlaps(covered: tuple[list[int], list[int]], a: int, b: int) -> bool:
    at = bisect_right(covered[1], a)
    return at < bisect_left(covered[0], b)


def _as_known(pairs: Iterable[tuple[str, str, float]]) -> Known:
    known: Known = {}
    for entity, term, disclosure in pairs:
        known.setdefault(entity, {})[term] = disclosure
    return known


def _attached(docs: DataFrame, rules: Rules) -> tuple[DataFrame, Known | None, str]:
    """``docs``, and the disclosing pairs for all tasks if they are few; else None, and in the named column those of a row's own entities and terms."""
    pairs = cut(disclosing(docs, rules))
    column, row = fresh(docs, "_pairs"), fresh(docs, "_row")
    if pairs.count() <= MAX_SENT_PAIRS:
        found = pairs.toArrow()
        return docs, _as_known(zip(*(found.column(x).to_pylist() for x in ("entity", "term", "disclosure")))), column

    def mentions(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                if base:
                    about = Surroundings(text)
                    found = {(k, t) for s in base for t, _, _ in about.of(s) for key in (entity_key(text, s),) for k in (key, group_key(key))}
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["row", "entity", "term"])

    # numbers of rows must not change between the two uses, so they are written with the rows
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = batches(kept.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), mentions, "row long, entity string, term string")
    own = own.join(pairs, ["entity", "term"]).groupBy("row").agg(F.collect_list(F.struct("entity", "term", "disclosure")).alias(column)).withColumnRenamed("row", row)
    return kept.join(own, row, "left").select(*docs.columns, column), None, column


def _own(cell: pa.Scalar) -> Known:
    return _as_known((r["entity"], r["term"], r["disclosure"]) for r in cell.as_py() or ())


def find(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone, base_sha256 and spans (``kind:start:end``, comma-joined, code points)."""
    given, known, _ = _attached(docs.select("doc_id", "text"), rules)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for i, text in enumerate(batch.column(1)):
                found = _spans(text.as_py() or "", known if known is not None else _own(batch.column(2)[i]))
                base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k != "term")
                for kind, own in zip(KINDS, counts):
                    own.append(sum(x[0] == kind for x in found))
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    given = given.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return batches(given, scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int, float]], rules: Rules) -> str:
    """The text with entities replaced by their kind and terms removed, or generalised to ``[term]`` where they disclose less."""
    out, end = [], 0
    for kind, a, b, value in spans:
        if a < end:
            end = max(end, b)
            continue
        strong = value >= (1 + rules.threshold) / 2
        out += [text[end:a], "" if kind == "term" and strong else f"[{kind}]"]
        end = b
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents with their texts sanitised; all columns stay, ``n_chars`` where present follows the new text."""
    names = docs.columns
    given, known, _ = _attached(docs, rules)
    text_at = names.index("text")

    def clean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            new = []
            for i, text in enumerate(batch.column(text_at)):
                text = text.as_py()
                spans = _spans(text, known if known is not None else _own(batch.column(len(names))[i])) if text else []
                new.append(masked(text, spans, rules) if spans else text)
            own = batch.set_column(text_at, batch.schema.field(text_at), pa.array(new, batch.schema.field(text_at).type))
            yield own.select(names)

    done = batches(given, clean, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done
