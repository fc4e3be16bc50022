"""BPE encoding and decoding with a contiguous rank array.

The vocabulary file (a public one, its path is a parameter) describes a byte-level BPE whose words end in ``</w>``:
texts are NFC-normalised, white space runs become one space, letters are lower-cased, and a pattern cuts words.
Each word is merged on its own: a contiguous array holds the parts between boundaries and the rank of every adjacent
pair; the least rank is found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed. That is
quadratic, and fast, for short words; words of more than ``LONG_WORD`` bytes use a heap over the same ranks.

Every distinct white-space-delimited chunk is encoded once per worker and remembered in a table of bounded size.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated rows
give repeated results; a very long text is encoded whole, one document at a time; columns beyond the two named ones are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches

#: From this many bytes on a word is merged with a heap.
LONG_WORD = 160
#: A task remembers so many chunks and words, none longer than so many characters; a worker that waits for the next task remembers none.
MEMO_ROWS, WORD_ROWS, MEMO_CHARS = 400_000, 200_000, 48
_NONE = 1 << 60
_ID_BITS = 20
#: White space as the tokenizer's patterns see it.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Where str.split() sees white space and the patterns don't.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_STOPS = frozenset(".,")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The parts between white space, each of which is encoded without regard to the others."""
    return _SPACE.split(text) if any(x in text for x in _ODD_SPACES) else text.split()


class _Memo(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk: str) -> bytes:
        ids = self.compute(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_ROWS:
            self.clear()


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + suffix] for x in letters]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[left] << _ID_BITS | vocab[right]
            self.merges.setdefault(key, rank << _ID_BITS | vocab[left + right])
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.special_at = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None
        self.hint = next(iter(special))[:2] if special else None
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.names = [""] * (1 + max([*vocab.values(), *special.values()]))
        for name, i in [*vocab.items(), *special.items()]:
            self.names[i] = name
        self.word_memo: dict[str, bytes] = {}
        self.memo = _Memo(self._chunk)

    def merge_word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank_of = self.merges.get
        ranks = [rank_of(a << _ID_BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = merged = least & ((1 << _ID_BITS) - 1)
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << _ID_BITS | merged, _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(merged << _ID_BITS | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        rank_of = self.merges.get
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        end = len(parts)
        live: list[int | None] = list(parts)

        def offer(i: int) -> None:
            j = after[i]
            if j < end and (found := rank_of(live[i] << _ID_BITS | live[j])) is not None:
                heapq.heappush(heap, (found >> _ID_BITS, i, live[i], live[j], found))

        heap: list[tuple] = []
        for i in range(end - 1):
            offer(i)
        while heap:
            _, i, a, b, found = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j >= end or live[j] != b:
                continue
            live[i] = found & ((1 << _ID_BITS) - 1)
            live[j] = None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in live if x is not None]

    def _plain(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if piece.isalpha():  # one word, or one with a stop behind it: no need to ask the pattern
            found = [piece]
        elif piece[-1:] in _STOPS and piece[:-1].isalpha():
            found = [piece[:-1], piece[-1]]
        else:
            found = self.words.findall(piece)
        out = []
        for word in found:
            ids = self.word_memo.get(word)
            if ids is None:
                parts = self.merge_word(word)
                ids = struct.pack(f"<{len(parts)}I", *parts)
                if len(word) <= MEMO_CHARS:
                    if len(self.word_memo) > WORD_ROWS:
                        self.word_memo.clear()
                    self.word_memo[word] = ids
            out.append(ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space."""
        if self.hint is None or self.hint not in chunk:
            return self._plain(chunk)
        ids, at = b"", 0
        for m in self.special_at.finditer(chunk):
            ids += self._plain(chunk[at : m.start()]) + struct.pack("<I", self.special[m[0]])
            at = m.end()
        return ids + self._plain(chunk[at:])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, chunks(text)))

    def forget(self) -> None:
        """Drop what is remembered of chunks and words: a task that ends does, for its worker may go on with another stage."""
        self.memo.clear()
        self.word_memo.clear()

    def decode(self, ids: bytes) -> str:
        """The text of ids: the tokens' names joined by spaces, since the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The worker's codec for a file."""
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every document: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary)
        for batch in rows:
            found = [use.encode(x or "") for x in batch.column(1).to_pylist()]
            use.memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())], ["doc_id", "ids", "n_tokens"])
        use.forget()

    return batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), encode, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of encoded documents: doc_id, text."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary)
        for batch in rows:
            found = [use.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return batches(encoded.select("doc_id", "ids"), decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: n_tokens, digest of its ids, digest of the text that the ids decode to. One pass, texts stay in the task."""

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary)
        for batch in rows:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = use.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(use.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            use.memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        use.forget()

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
