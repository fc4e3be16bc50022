"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

A bin is filled greedily, always with the longest piece that fits. While it has a gap, its smallest piece is replaced
by two unpacked pieces that together fit the gap so expanded more tightly.

The heuristic needs the pieces' lengths only, of which there are at most ``capacity`` different ones. So the plan is
made from the histogram of lengths (a table whose size doesn't depend on the data): each step makes one kind of bin
and repeats it as often as the remaining counts allow. The pieces themselves never meet: each takes the place that its
rank among the pieces of its length has in the plan. Ranks come from counts per (length, shard), so that a length
which a third of the pieces share is numbered by many tasks; shards deal out rows by number and grow with the table, so
copies of one row are spread like others.

Defined results: a null text counts as empty; an empty text is the end id alone; only documents longer than
``capacity`` are cut, and only their last piece may be shorter; repeated rows are packed as often as they occur, a null
doc_id like any other; a long text is tokenized whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.bpe import Codec, byte_letters
from tracewright.llm.common import batches, cut

CAPACITY = 2048
#: The pieces of one length are numbered by a task for about so many pieces of the table, but by so many tasks at least.
SHARD_ROWS, MIN_SHARDS = 20_000_000, 64
#: Counts per length and shard are sent to tasks up to this number; more of them are joined.
MAX_SENT_COUNTS = 1_000_000
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class LibraryTokens(Codec):
    """Ids by the tokenizers library's model, which is asked once for every word that a worker remembers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = byte_letters()

    def merge_word(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))))]


@lru_cache(maxsize=4)
def library_tokens(path: str) -> LibraryTokens:
    return LibraryTokens(path)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids themselves."""

    def tokenize(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = library_tokens(vocabulary)
        step = 4 * capacity
        for batch in rows:
            for first in range(0, batch.num_rows, 250):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for d, text in zip(batch.column(0).slice(first, 250).to_pylist(), batch.column(1).slice(first, 250)):
                    ids = use.encode(text.as_py() or "") + END
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            use.memo.trim()
        use.forget()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return batches(source, tokenize, PIECES + (", ids binary" if keep_ids else ""))


def _tighter_pair(free: np.ndarray, below: np.ndarray, target: int, least: int) -> tuple[int, int] | None:
    """The two lengths in stock with the largest sum in (least, target]."""
    a = np.flatnonzero(free[: target + 1])
    a = a[a < target]
    if not len(a):
        return None
    b = below[np.minimum(target - a, a)]
    alone = (b == a) & (free[a] < 2)
    b = np.where(alone, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if total[best] > least else None


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """A plan for ``counts[length]`` pieces of each length from 1 to capacity.

    Rows (length, first rank, copies in a bin, bins, first bin, offset in each bin): the pieces of that length with
    ranks from the first one on fill ``bins`` consecutive bins with ``copies`` pieces each.
    """
    left = np.array(counts[: capacity + 1], dtype=np.int64)
    left[0] = 0
    lengths = np.arange(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bin_no = 0
    while left.any():
        free = left.copy()
        below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        own: dict[int, int] = {}
        gap, limit = capacity, capacity
        while (size := int(below[min(gap, limit)])) > 0:
            own[size] = copies = min(int(free[size]), gap // size)
            free[size] -= copies
            gap -= copies * size
            limit = size - 1
        while gap:
            smallest = min(own)
            below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            pair = _tighter_pair(free, below, gap + smallest, smallest)
            if pair is None:
                break
            own[smallest] -= 1
            free[smallest] += 1
            if not own[smallest]:
                del own[smallest]
            for x in pair:
                own[x] = own.get(x, 0) + 1
                free[x] -= 1
            gap += smallest - sum(pair)
        bins = min(int(left[x]) // n for x, n in own.items())
        offset = 0
        for x, n in sorted(own.items(), reverse=True):
            plan.append((x, int(taken[x]), n, bins, bin_no, offset))
            taken[x] += n * bins
            left[x] -= n * bins
            offset += n * x
        bin_no += bins
    return plan


def ranked(pieces: DataFrame, shards: int = MIN_SHARDS) -> DataFrame:
    """``pieces``, whose ``row`` is a number of its own, with ``rank``: a number, from 0, among the pieces of the same length."""
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sharded.groupBy("length", "_shard").agg(F.count("*").alias("_n")).select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if (CAPACITY + 1) * shards <= MAX_SENT_COUNTS:  # a row of three numbers for each length and shard
        base = F.broadcast(base)
    within = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("row"))
    return sharded.withColumn("_within", within - 1).join(base, ["length", "_shard"]).withColumn("rank", F.col("_base") + F.col("_within")).drop("_shard", "_within", "_base")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A place for every piece of every document: the columns of ``tokenized_pieces``, sequence_id, offset."""
    # a piece's number is kept with it, so that it is the same in all that follows
    pieces = cut(tokenized_pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    shards = max(MIN_SHARDS, int(counts.sum()) // SHARD_ROWS)
    plan = np.array(best_two_fit(counts, capacity) or [(0, 0, 1, 1, 0, 0)], dtype=np.int64)
    keys = plan[:, 0] << 44 | plan[:, 1]
    order = np.argsort(keys)
    plan, keys = plan[order], keys[order]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            columns = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 4] + nth // at[:, 2]), pa.array(at[:, 5] + nth % at[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return batches(ranked(pieces, shards).select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), place, PIECES + ", sequence_id long, offset long")


def assemble(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary), from ``pack`` and ``tokenized_pieces(keep_ids=True)``.

    A sequence holds at most ``capacity`` tokens, so a group is bounded. Rows that repeat must be told apart by doc_id.
    """
    parts = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    sorted_parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(sorted_parts, lambda x: x["ids"]), "")).alias("ids"))
