"""Chat formatting at token level.

A turn becomes ``<start>`` role line-break text ``<end>`` line-break. Role and text are encoded apart from each other
and from the marks, so no token crosses a boundary; the marks are reserved ids that no text encodes to. Control
strings in roles and texts are escaped, reversibly: between ``<`` and ``|`` one more backslash is put, so that no
escaped text contains ``<|``. The loss mask is derived by prefix sums: +1 where a text to learn begins, -1 behind it.

Rows are turns. Every turn is encoded where it lies; then turns of a conversation are brought together in order, and
read row by row, so that a conversation of any length passes through a task in bounded memory.

Order in a conversation: turn (null first), then role, then the text's first letters, then its digest. Defined results:
a null role or text counts as empty, a null conv_id is a conversation of its own, repeated rows are repeated turns, a
long text is encoded whole, other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches, runs

#: How the marks are written out; as ids they come after the vocabulary's.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLES = ("assistant",)
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, turn long, role_key string, text_key string, ids array<int>, loss array<byte>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and without line breaks, since the first one ends the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


class Tokens:
    """A rank file's encoder with two reserved ids behind its vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={START: self.start, END: self.end})
        self.line = self.encode("\n")
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings that look like marks are ordinary text here."""
        return self.encoding.encode_ordinary(text)

    def header(self, role: str) -> list[int]:
        if len(self.memo) > 10_000:
            self.memo.clear()
        if role not in self.memo:
            self.memo[role] = self.encode(escape_role(role) + "\n")
        return self.memo[role]

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def assemble(use: Tokens, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns' ids in a row, their loss mask, and where each turn begins (with the end behind the last)."""
    parts: list[list[int]] = []
    for role, text in zip(roles, texts):
        parts += [[use.start], use.header(role), use.encode(escape(text)), [use.end], use.line]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((i for x in parts for i in x), dtype=np.int32, count=int(bounds[-1]))
    learnt = np.array([r in LEARNT_ROLES for r in roles], dtype=np.int64)
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(steps, bounds[2:-1:5], learnt)
    np.add.at(steps, bounds[3:-1:5], -learnt)
    return ids, np.cumsum(steps)[:-1].astype(np.int8), bounds[::5]


def format_turns(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Ids and loss mask of every turn, with what orders turns: conv_id, turn, role_key, text_key, ids, loss.

    A conversation's sequence is its turns' ids in the order of (turn, role_key, text_key).
    """

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokens(vocabulary)
        for batch in rows:
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            ids, loss, begins = assemble(use, roles, texts)
            offsets = pa.array(begins.astype(np.int32))
            # equal prefixes fall back on the digest: equal texts have equal turns, so their order doesn't matter
            keys = [x[:64] + "\0" + hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if len(x) > 64 else x for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(loss))],
                ["conv_id", "turn", "role_key", "text_key", "ids", "loss"],
            )

    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return batches(source, encode, TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


READ = "conv_id long, turn long, role_key string, text_key string, said string, learnt string, whole boolean, chars long, tokens long, loss_tokens long"


def read_back(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Every turn as its ids and mask say it: ``said`` (role, line break, text, line break), the text under the mask, the written-out turn's characters, ids, and ids under the mask.

    ``whole``: the mask covers just the turn's text, which then isn't repeated in ``learnt``; such a turn's role has no line break.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokens(vocabulary)
        for batch in rows:
            out = []
            for ids, loss in zip(batch.column(4), batch.column(5)):
                ids, mask = ids.values.to_numpy(), loss.values.to_numpy().astype(bool)
                written = use.bytes_of(ids.tolist()).decode("utf-8")
                body = use.bytes_of(ids[1 : np.flatnonzero(ids == use.end)[0]].tolist()).decode("utf-8")
                role, _, text = body.partition("\n")
                text = unescape(text)
                learnt = unescape(use.bytes_of(ids[mask].tolist()).decode("utf-8"))
                whole = bool(learnt) and learnt == text
                out.append((f"{unescape_role(role)}\n{text}\n", None if whole else learnt, whole, len(written), len(ids), int(mask.sum())))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], [x.split()[0] for x in READ.split(", ")])

    return batches(turns.select("conv_id", "turn", "role_key", "text_key", "ids", "loss"), read, READ)


def digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """What formatted conversations hold, read back from their ids and masks.

    turns_sha256 is of role, line break, text, line break per turn; loss_chars and loss_sha256 are of all text under the
    loss mask; formatted_chars counts the written-out sequence. Turns are decoded where they lie; what follows in a
    conversation's order is hashing alone, and digests grow as turns pass, so nothing is gathered.
    """

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def done(s: dict) -> pa.RecordBatch:
            values = [s["conv_id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["loss_tokens"]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in DIGESTS.split(", ")])

        for (conv_id,), part, new in runs(rows, ["conv_id"]):
            if new:
                if state is not None:
                    yield done(state)
                state = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0, "loss_tokens": 0}
            for said, learnt, whole, chars, tokens_of, loss_tokens in zip(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in ("said", "learnt", "whole", "chars", "tokens", "loss_tokens"))):
                text = said.partition("\n")[2][:-1] if whole else learnt
                state["n"] += 1
                state["turns"].update(said.encode())
                state["loss"].update(text.encode())
                state["loss_chars"] += len(text)
                state["chars"] += chars
                state["tokens"] += tokens_of
                state["loss_tokens"] += loss_tokens
        if state is not None:
            yield done(state)

    order = ["conv_id", "turn", "role_key", "text_key"]
    return batches(read_back(turns, vocabulary).repartition("conv_id").sortWithinPartitions(*order), digest, DIGESTS)
