"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, by turn, are edited to be an optional system turn and then turns of user and assistant in pairs:
their roles' initials are ``(s?(ua)+)?``. An edit keeps a row (K, costs 0), gives it the role user or assistant (R, 3),
deletes it (D, 4; a must for a row that is blank or a duplicate) or inserts an empty turn before it or at the end (I, 3);
a truncated row that stays costs 3 more. Which role R and I give follows from the turn before, so the initials of the
edits say it all. The cheapest edits are taken, of equally cheap ones those whose initials come first in ASCII.

The search goes depth first through edits in ASCII order (D, I, K, R), as far as cost and what is still unavoidable stay
within a bound, which then rises to the least that would have let it go on. What a state that failed costs at least is
remembered in a table, which later rounds and other paths use. So the first path that is accepted is the answer.

Search goes by pieces of at most ``PIECE`` rows, so that its work grows with rows, however long a conversation is, and a
conversation may lie on several tasks: of each piece the search gives the cheapest edits from every state it may be
entered in to every state it may be left in. Edits of a piece end with its last row's, so no piece's edits begin
another's, and the first of all is the first in each piece: a conversation's edits are put together of pieces by their
costs from behind and by their initials from the front. A piece that is a whole conversation is searched once.

Rows are dealt to tasks by ranges of (conv_id, turn, role, text), so a conversation of any size, or one row repeated any
number of times, spreads. A conversation's edits are one string, and its edited turns come in order, so that last step
goes through its rows one by one, with a batch of them in memory.

Defined results: null turns come first; rows of one turn are taken by role, then by the first characters of the text, then
by its digest; a null conv_id, role or text is one space (rows without conv_id are a conversation of their own); an empty
role counts as one space; repeated rows are duplicates; very long texts are one row as any other; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import batches, runs, written

#: White space: fixed values.
SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
PIECE = 16
#: So many characters of a text order rows of one turn and role; the digest does behind them.
HEAD = 64
#: States: nothing yet, behind system, behind user, behind assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By state, what a turn with an initial leads to.
_NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: By state, the role that R and I give, and what they lead to.
_GIVEN = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
#: By state, how many turns are to be inserted at the end.
_TAIL = [0, 2, 1, 0]
#: A row is one letter: its role's initial (``.`` for others), in upper case where it is truncated; ``-`` must be deleted.
MUST = "-"
NONE = 1 << 30


def unavoidable(row: str) -> int:
    """What a row costs at least."""
    if row == MUST:
        return DELETE
    if row == ":":  # of no known role, and truncated
        return min(DELETE, REROLE + TRUNCATED)
    if row == ".":
        return min(REROLE, DELETE)
    return min(TRUNCATED, DELETE) if row.isupper() else 0


class Search:
    """Iterative-deepening A* over some rows from a state to another, or to a conversation's end (``leave`` None)."""

    def __init__(self, rows: str, leave: int | None):
        self.rows, self.leave = rows, leave
        self.ahead = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.ahead[i] = self.ahead[i + 1] + unavoidable(rows[i])
        #: What failed states (row, state) cost at least from there on.
        self.failed: dict[tuple[int, int], int] = {}
        self.path: list[str] = []

    def least(self, i: int, state: int) -> int:
        return max(self.ahead[i], self.failed.get((i, state), 0))

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: initial, cost, next row, next state."""
        if i == len(self.rows):
            if self.leave is None:
                yield "I", INSERT, i, _GIVEN[state][1]
            return
        row = self.rows[i]
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, _GIVEN[state][1]
        if row != MUST:
            more = TRUNCATED if row.isupper() or row == ":" else 0
            if row.lower() in _NEXT[state]:
                yield "K", more, i + 1, _NEXT[state][row.lower()]
            yield "R", REROLE + more, i + 1, _GIVEN[state][1]

    def within(self, i: int, state: int, room: int) -> int:
        """-1 if a path from here costs no more than ``room`` (``path`` is it), else what all of them cost at least."""
        if i == len(self.rows) and (state in (NOTHING, ASSISTANT) if self.leave is None else state == self.leave):
            return -1
        at_least = NONE
        for edit, cost, j, then in self.edits(i, state):
            bound = cost + self.least(j, then)
            if bound <= room:
                self.path.append(edit)
                found = self.within(j, then, room - cost)
                if found < 0:
                    return -1
                self.path.pop()
                bound = cost + found
            at_least = min(at_least, bound)
        self.failed[i, state] = max(at_least, self.failed.get((i, state), 0))
        return at_least

    def run(self, enter: int) -> tuple[int, str] | None:
        """The cost and the edits of the answer; None if there is no way."""
        if self.leave == NOTHING != enter or self.leave == SYSTEM and (enter > SYSTEM or enter == NOTHING and "s" not in self.rows.lower()):
            return None
        most = DELETE * len(self.rows) + 3 * INSERT + TRUNCATED  # deleting all but one row, and the turns to insert
        room = self.least(0, enter)
        while room <= most:
            found = self.within(0, enter, room)
            if found < 0:
                return room, "".join(self.path)
            room = found
        return None


@lru_cache(maxsize=20_000)
def cheapest(rows: str) -> tuple[int, str] | None:
    """Of a whole conversation."""
    return Search(rows, None).run(NOTHING)


@lru_cache(maxsize=5_000)
def ways(rows: str) -> tuple[list[int], list[str]]:
    """Costs and edits of a piece, by 4 * entry + exit; ``NONE`` where there is no way."""
    costs, paths = [], []
    for enter in range(4):
        for leave in range(4):
            found = Search(rows, leave).run(enter)
            costs.append(NONE if found is None else found[0])
            paths.append("" if found is None else found[1])
    return costs, paths


def joined(pieces: list[tuple[np.ndarray, str]]) -> tuple[int, str]:
    """A conversation's cost and edits of its pieces' costs (16) and edits (16, by commas)."""
    behind = np.zeros((len(pieces) + 1, 4), np.int64)
    behind[-1] = [INSERT * n for n in _TAIL]
    for i in range(len(pieces) - 1, -1, -1):
        behind[i] = (pieces[i][0].reshape(4, 4) + behind[i + 1]).min(axis=1)
    state, out = NOTHING, []
    for i, (costs, paths) in enumerate(pieces):
        total = costs.reshape(4, 4)[state] + behind[i + 1]
        split = paths.split(",")
        path, state = min((split[4 * state + leave], leave) for leave in range(4) if total[leave] == behind[i][state])
        out.append(path)
    return int(behind[0][NOTHING]), "".join(out) + "I" * _TAIL[state]


class Editor:
    """Applies a conversation's edits to its rows as they pass: the edited turns, as (edit, role, text); a deleted row has its own."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _given(self) -> str:
        role, self.state = _GIVEN[self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state][role[0]]
        elif edit == "R":
            role = self._given()
        yield edit, role, text


ORDERED = "conv_id long, place long, turn long, role string, text string, blank boolean, cut boolean, digest string"
PIECES = "conv_id long, place long, rows string, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, costs array<int>, paths string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EDITED = "conv_id long, position long, edit string, role string, text string"


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows in order, ``place`` ascending with it, written once; blank and cut say what is wrong with a row by itself."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.coalesce(F.col("role").cast("string"), blank) == "", blank).otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    # equal rows are told apart by where they are read, only that any number of them spreads
    rows = rows.withColumns({"_head": F.substring("text", 1, HEAD), "digest": F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256), "_read": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_head", "digest", "_read"]
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        placed.select(
            "conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", "text",
            (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"), "digest",
        ),
        "ordered-turns",
    )


def pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations with their counts and what their edits cost: those of one conversation ascend with ``place``."""
    seen = rows.filter(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first_seen"))
    marked = rows.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(seen, "place", "left")
    marked = marked.withColumn("fault", F.when(F.col("blank"), "b").when(F.col("first_seen").isNull(), "d").when(F.col("cut"), "t").otherwise("n"))
    marked = marked.select("conv_id", "place", "turn", "initial", "fault")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []  # place, turn, initial, fault
        conv: int | None = None
        inside = False  # whether the conversation begins behind another one of this task, so that none of its rows lies on the task before

        def close(whole: bool) -> None:
            if held:
                out.append(_piece(conv, held, whole))
                held.clear()

        first = True
        for (found,), part, new in runs(parts, ["conv_id"]):
            if new:
                close(inside)
                inside, first, conv = not first, False, found
            for row in zip(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in ("place", "turn", "initial", "fault"))):
                if len(held) == PIECE:
                    close(False)
                    inside = False
                held.append(row)
            if len(out) > 5_000:
                yield _pieces_batch(out)
                out.clear()
        close(False)
        yield _pieces_batch(out)

    return batches(marked.repartitionByRange("place").sortWithinPartitions("place"), search, PIECES)


def _piece(conv: int | None, held: list[tuple], whole: bool) -> tuple:
    places, turns, initials, faults = zip(*held)
    letters = [MUST if f in "bd" else (i if i in "sua" else ".") for i, f in zip(initials, faults)]
    letters = [(":" if x == "." else x.upper()) if f == "t" else x for x, f in zip(letters, faults)]
    rows = "".join(letters)
    known = [t for t in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    if whole:
        cost, audit = cheapest(rows)
        costs, paths = [cost], audit
    else:
        costs, found = ways(rows)
        paths = ",".join(found)
    return (
        conv, places[0], rows, whole, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
        sum(a != b for a, b in zip(known, known[1:])) + bool(known), known[0] if known else None, known[-1] if known else None, initials[0], initials[-1], costs, paths,
    )


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, PIECES)


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(found: DataFrame) -> DataFrame:
    """Per conversation: its counts, the cost of its edits and their initials."""

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple[np.ndarray, str]] = []
        sums: dict | None = None

        def close() -> None:
            if sums is not None:
                cost, audit = (int(held[0][0][0]), held[0][1]) if sums["whole"] else joined(held)
                gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
                out.append((sums["conv"], gaps, *sums["counts"], sums["illegal"], cost, audit))
            held.clear()

        for (conv,), part, new in runs(parts, ["conv_id"]):
            if new:
                close()
                sums = {"conv": conv, "low": None, "high": None, "turns": 0, "counts": [0, 0, 0], "illegal": 0, "last": None, "whole": False}
                if len(out) > 5_000:
                    yield _batch(out, AUDITS)
                    out.clear()
            for r in part.to_pylist():
                sums["whole"] = r["whole"]
                sums["counts"] = [a + r[x] for a, x in zip(sums["counts"], ("blank", "duplicate", "truncated"))]
                sums["illegal"] += r["illegal"] + (sums["last"] is not None and sums["last"] + r["first"] not in ("su", "ua", "au"))
                sums["last"] = r["last"]
                if r["first_turn"] is not None:  # a turn that goes on over pieces is one
                    sums["turns"] += r["turns"] - (sums["high"] == r["first_turn"])
                    sums["low"] = r["first_turn"] if sums["low"] is None else sums["low"]
                    sums["high"] = r["last_turn"]
                held.append((np.array(r["costs"], np.int64), r["paths"]))
        close()
        yield _batch(out, AUDITS)

    return batches(found.repartition("conv_id").sortWithinPartitions("conv_id", "place"), join, AUDITS)


DIGESTS = f"{AUDITS}, repaired_sha256 string"
_NO_AUDIT = -1


def _with_audits(rows: DataFrame, found: DataFrame, every: DataFrame | None) -> DataFrame:
    """A conversation's audit, then its rows in order, together in one task; ``every`` adds conversations without rows."""
    none = [F.lit(0).cast("long").alias(x) for x in COUNTS]
    heads = found.select("conv_id", F.lit(_NO_AUDIT).cast("long").alias("place"), *COUNTS, "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = rows.select("conv_id", "place", *none, F.lit(None).cast("string").alias("audit"), "role", "text")
    both = heads.unionByName(body)
    if every is not None:
        ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        both = both.unionByName(ids.select("conv_id", F.lit(_NO_AUDIT - 1).cast("long").alias("place"), *none, F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _edited(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, bool, Iterator[tuple[str, str, str]]]]:
    """Rows of ``_with_audits`` as they pass: the conversation's audit (None where it has no rows), whether it is a new one, and the edited turns that come next."""
    editor: Editor | None = None
    for (conv,), part, new in runs(parts, ["conv_id"]):
        if new:
            if editor is not None:
                yield {}, False, editor.inserted()
            editor = None
            yield {"conv_id": conv}, True, iter(())
        for r in part.to_pylist():
            if r["place"] == _NO_AUDIT:
                editor = Editor(r["audit"])
                yield r, False, iter(())
            elif r["place"] >= 0:
                yield {}, False, editor.row(r["role"], r["text"])
    if editor is not None:
        yield {}, False, editor.inserted()


def repair(conversations: DataFrame) -> DataFrame:
    """The edited turns: conv_id, position (from 0, by edit), edit, role, text. Deleted rows are there, marked D; what is left is the others."""
    rows = ordered(conversations)

    def edit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, position, chars = None, 0, 0
        for head, new, turns in _edited(parts):
            if new:
                conv, position = head["conv_id"], 0
            for letter, role, text in turns:
                out.append((conv, position, letter, role, text))
                position += 1
                chars += len(text)
            if len(out) > 2_000 or chars > 4 << 20:
                yield _batch(out, EDITED)
                out.clear()
                chars = 0
        yield _batch(out, EDITED)

    return batches(_with_audits(rows, audits(pieces(rows)), None), edit, EDITED)


def digests(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation: counts, cost and audit, and the digest of its repaired turns (``role:text``, joined by line breaks).

    ``every`` names conversations (conv_id) to be listed besides, with zeros, if they have no rows.
    """
    rows = ordered(conversations)

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict | None = None

        def close() -> None:
            if state is not None:
                out.append((state["conv_id"], *state["counts"], state["audit"], state["sha"].hexdigest()))

        for head, new, turns in _edited(parts):
            if new:
                close()
                state = {"conv_id": head["conv_id"], "counts": [0] * len(COUNTS), "audit": "", "sha": hashlib.sha256(), "any": False}
                if len(out) > 2_000:
                    yield _batch(out, DIGESTS)
                    out.clear()
            elif head:
                state["counts"], state["audit"] = [head[x] for x in COUNTS], head["audit"]
            for edit, role, text in turns:
                if edit != "D":
                    state["sha"].update(f"{chr(10) * state['any']}{role}:{text}".encode())
                    state["any"] = True
        close()
        yield _batch(out, DIGESTS)

    return batches(_with_audits(rows, audits(pieces(rows)), every), digest, DIGESTS)
