"""Lines of byte ranges of text files: what an index, a search's next step or a tail names is read, and nothing else.

Ranges are rows of a DataFrame, so any number of them passes without the driver. They are cut into slices that tasks read
on their own: a slice owns the lines that begin in it, and reads on behind its end for the last one's end. Of a line no
more bytes are held than its cap, however long it is. Tails are read from a file's end backwards, in blocks, until there
are enough line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.functions.parsers import Parser, is_header
from tracewright.sources.lines import FOLDABLE, LINES, MAX_LINE_LENGTH
from tracewright.sources.stores import file_system, sizes

SCHEMA = "file string, key long, block long, first boolean, n long, offset long, end_offset long, raw string, truncated boolean"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
SLICE_BYTES = 64 << 20
#: A task takes slices of about so many bytes together; no more tasks are made than ``MOST_TASKS``.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000
#: Bytes that are read at a time, in a step back, and at least at once behind a range's end.
_READ, _STEP, _BEHIND = 4 << 20, 64 << 10, 8 << 10
#: Of what is read, so many bytes are lines at a time: a short line costs as objects some ten times its bytes.
_PIECE = 256 << 10
_MARK = b"\xef\xbb\xbf"
#: A line: offset, end offset, bytes up to the cap, whether a line break ends it.
Line = tuple[int, int, bytes, bool]


class Counted:
    """A file that adds what is read from it to a meter."""

    def __init__(self, f, meter: Accumulator | None):
        self.f, self.meter, self.seek, self.size = f, meter, f.seek, f.size

    def read(self, n: int) -> bytes:
        found = self.f.read(n)
        if self.meter is not None:
            self.meter.add(len(found))
        return found


def line_start(f, at: int) -> int:
    """Where the line begins that holds byte ``at``: behind the last line break before it."""
    while at > 0:
        low = max(0, at - _STEP)
        f.seek(low)
        cut = f.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return 0


def next_start(f, begin: int, end: int) -> int | None:
    """Where the first line begins that begins in [begin, end); None if none does. Nothing before ``begin - 1`` or behind ``end`` is read."""
    if begin == 0:
        return 0 if end > 0 else None
    at = begin - 1
    f.seek(at)
    while at < end - 1:
        block = f.read(min(_STEP, end - 1 - at))
        if not block:
            return None
        cut = block.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(block)
    return None


def lines_between(f, start: int, end: int, size: int, cap: int | None = None, most: int = _READ) -> Iterator[list[Line]]:
    """The lines that begin in [start, end), in lists of a piece of what is read at a time (``most`` bytes); ``start`` is a line's start. Bytes behind a line's ``cap`` are passed over."""
    f.seek(start)
    at = pos = start  # where the open line begins, and what is taken next
    kept = b""
    while at < end:
        block = f.read(min(most, max(end - pos, _BEHIND, pos - end), size - pos))
        if not block:
            if pos > at:
                yield [(at, pos, kept, False)]
            return
        for low in range(0, len(block), _PIECE):
            piece = block[low : low + _PIECE]
            *whole, rest = piece.split(b"\n")
            out: list[Line] = []
            for i, line in enumerate(whole):
                if at >= end:
                    break
                stop = (pos if not i else at) + len(line) + 1
                line = line if i else kept + line
                out.append((at, stop, line if cap is None else line[:cap], True))
                at = stop
            if whole:
                kept = b""
            kept = kept + rest if cap is None else kept + rest[: cap - len(kept)]
            pos += len(piece)
            yield out
            if at >= end:
                return


def tail_start(f, end: int, n: int) -> int:
    """Where the last ``n`` lines before ``end`` begin."""
    at, breaks = end, -1
    f.seek(max(0, end - 1))
    if end and f.read(1) != b"\n":
        breaks = 0
    while at > 0:
        low = max(0, at - _STEP)
        f.seek(low)
        block = f.read(at - low)
        held = block.count(b"\n")
        if breaks + held >= n:
            cut = len(block)
            while breaks < n:
                cut = block.rfind(b"\n", 0, cut)
                breaks += 1
            return low + cut + 1
        breaks += held
        at = low
    return 0


def rows_of(some: list[Line], limit: int | None) -> tuple[list[str], list[bool]]:
    """Texts and whether they are cut: a terminated line of just the limit counts as cut, an unterminated one doesn't."""
    raw, cut = [], []
    for a, b, x, ended in some:
        x = x.removeprefix(_MARK) if a == 0 else x
        raw.append((x if limit is None else x[:limit]).rstrip(b"\r\n").decode("utf-8", "replace"))
        length = b - a - ended
        cut.append(limit is not None and (length > limit or ended and length == limit))
    return raw, cut


def _read(rows: Iterator[pa.RecordBatch], limit: int | None, meter: Accumulator | None) -> Iterator[pa.RecordBatch]:
    """Lines of slices (file, key, start, end, first, head, tail): those that begin in it, or its first ``head`` or last ``tail`` ones."""
    for batch in rows:
        for one in batch.to_pylist():
            fs, path = file_system(one["file"])
            with fs.open_input_file(path) as opened:
                f = Counted(opened, meter)
                size = f.size()
                end = min(one["end"], size)
                start = tail_start(f, end, one["tail"]) if one["tail"] else next_start(f, one["start"], end)
                n = 0
                for some in lines_between(f, start, end, size, None if limit is None else limit + len(_MARK), _STEP if one["head"] else _READ) if start is not None else ():
                    some = some[: one["head"] - n] if one["head"] else some
                    if some:
                        raw, cut = rows_of(some, limit)
                        k = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([one["file"]] * k, pa.string()), pa.array([one["key"]] * k, pa.int64()), pa.array([one["start"]] * k, pa.int64()), pa.array([one["first"] and not n and not i for i in range(k)], pa.bool_()),
                                pa.array(range(n + 1, n + k + 1), pa.int64()), pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array(raw, pa.string()), pa.array(cut, pa.bool_()),
                            ],
                            _NAMES,
                        )
                    n += len(some)
                    if one["head"] and n >= one["head"]:
                        break


def ranges_of(spark: SparkSession, ranges: Sequence[tuple[str, int, int]]) -> DataFrame:
    """(file, start, end) as a DataFrame."""
    files, starts, ends = zip(*ranges) if ranges else ((), (), ())
    return spark.createDataFrame(pa.table({"file": pa.array(files, pa.string()), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())}))


def range_lines(ranges: DataFrame, max_line_length: int | None = MAX_LINE_LENGTH, slice_bytes: int = SLICE_BYTES, meter: Accumulator | None = None, total: int | None = None) -> DataFrame:
    """The lines that begin in ranges (file, start, end; start may be any byte), with ``key`` (a range's own, else its start), the slice's start as ``block``, whether a line is its range's ``first``, and its place ``n`` in the slice.

    With a column ``head`` or ``tail`` only so many lines of a range, the first or the last ones; such a range isn't cut.
    """
    return _sliced(ranges, max_line_length, slice_bytes, meter, total)[0]


def _sliced(ranges: DataFrame, max_line_length: int | None, slice_bytes: int, meter: Accumulator | None, total: int | None = None) -> tuple[DataFrame, bool]:
    """``range_lines``, and whether every range is a slice. ``total`` is the ranges' bytes, where they are known to be few enough for that."""
    nothing = F.lit(0).cast("long")
    given = ranges.columns
    whole = [c for c in ("head", "tail") if c in given]
    own = ranges.select("file", (F.col("key") if "key" in given else F.col("start")).alias("key"), F.col("start").alias("_start"), F.col("end").alias("_end"), *((F.col(c).cast("long") if c in given else nothing).alias(c) for c in ("head", "tail"))).filter("_start < _end")
    pieces = F.array(F.col("_start")) if whole else F.expr(f"sequence(_start, _end - 1, {slice_bytes}L)")
    cut = own.select("*", F.explode(pieces).alias("start")).select("file", "key", "start", (F.col("_end") if whole else F.least(F.col("start") + slice_bytes, F.col("_end"))).alias("end"), (F.col("start") == F.col("_start")).alias("first"), "head", "tail")
    if total is not None and total <= slice_bytes:
        return cut.repartition(-(-total // TASK_BYTES) or 1).mapInArrow(lambda rows: _read(rows, max_line_length, meter), SCHEMA), True
    size = cut.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.bool_and("first").alias("whole")).first()
    tasks = max(1, min(size["n"], MOST_TASKS, max(-(-(size["bytes"] or 0) // TASK_BYTES), ranges.sparkSession.sparkContext.defaultParallelism)))
    return cut.repartition(tasks).mapInArrow(lambda rows: _read(rows, max_line_length, meter), SCHEMA), size["whole"] is not False


def read_ranges(ranges: DataFrame, max_line_length: int | None = MAX_LINE_LENGTH, slice_bytes: int = SLICE_BYTES, headers: bool = False, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None, total: int | None = None) -> DataFrame:
    """Lines of ranges (file, start, end) that don't overlap; line_no ascends along a file, without gaps in a range.

    With ``headers`` lines are prepared for folding by the same ``parsers``, and every range begins with a record: its
    first line begins one, whether it is a header or not. Ranges of a slice each are numbered by where they lie and are
    read once; longer ones are read a second time for their slices' totals. ``total`` is the ranges' bytes, if known.
    """
    rows, whole = _sliced(ranges, max_line_length, slice_bytes, meter, total)
    rows = rows.withColumn("is_header", is_header(F.col("raw"), None if parsers is None else list(parsers)) if headers else F.lit(False))
    begins = F.col("is_header") | F.col("first") & (F.col("offset") > 0)
    own = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if whole:  # a slice's lines are fewer than its bytes
        rows = rows.withColumn("line_no", F.col("block") + F.col("n"))
        if headers:
            rows = rows.withColumn("header_line", F.last(F.when(begins, F.col("line_no")), ignorenulls=True).over(own))
        return rows.select(*LINES, *FOLDABLE * headers)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    totals = rows.groupBy("file", "block").agg(F.max("n").alias("_lines"), F.max(F.when(begins, F.col("n"))).alias("_last"))
    base = totals.withColumn("_first", F.coalesce(F.sum("_lines").over(before), F.lit(0).cast("long")))
    base = base.withColumn("_before", F.last(F.col("_first") + F.col("_last"), ignorenulls=True).over(before)).drop("_lines", "_last")
    rows = rows.withColumn("_own", F.last(F.when(begins, F.col("n")), ignorenulls=True).over(own)) if headers else rows.withColumn("_own", F.lit(None).cast("long"))
    rows = rows.join(base, ["file", "block"]).withColumns({"line_no": F.col("_first") + F.col("n"), "header_line": F.coalesce(F.col("_first") + F.col("_own"), "_before")})
    return rows.select(*LINES, *FOLDABLE * headers)


def files_in(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file and size of the files of folders or globs."""
    found = [(f, n) for path in ([paths] if isinstance(paths, str) else paths) for f, (n, _) in sizes(path, hidden=False).items()]
    return spark.createDataFrame(pa.table({"file": pa.array([f for f, _ in found], pa.string()), "size": pa.array([n for _, n in found], pa.int64())}))


def read_bounded(files: DataFrame, max_line_length: int = MAX_LINE_LENGTH, slice_bytes: int = SLICE_BYTES, headers: bool = False, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None) -> DataFrame:
    """All lines of files (file, size), as ``read_lines``, but for the memory: a line of any length costs its cap.

    Spark's own text reader, which ``read_lines`` uses, is faster and holds a line whole.
    """
    return read_ranges(files.select("file", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), max_line_length, slice_bytes, headers, parsers, meter)


def read_tails(spark: SparkSession, paths: str | Sequence[str], n: int, max_line_length: int = MAX_LINE_LENGTH, meter: Accumulator | None = None) -> DataFrame:
    """The last ``n`` lines of each file of the folders or globs, read from its end; line_no counts from the first of them."""
    return read_before(files_in(spark, paths).withColumnRenamed("size", "cursor"), n, max_line_length, meter)


def read_before(cursors: DataFrame, n: int, max_line_length: int = MAX_LINE_LENGTH, meter: Accumulator | None = None) -> DataFrame:
    """The last ``n`` lines of each file before its cursor (file, cursor), a line's start or the end; line_no counts from the first of them."""
    own = cursors.select("file", F.lit(0).cast("long").alias("start"), F.col("cursor").alias("end"), F.lit(max(1, n)).alias("tail"))
    return range_lines(own, max_line_length, meter=meter).withColumnRenamed("n", "line_no").select(LINES)


def read_after(cursors: DataFrame, n: int, max_line_length: int = MAX_LINE_LENGTH, meter: Accumulator | None = None) -> DataFrame:
    """The first ``n`` lines of each file that begin at or behind its cursor (file, size, cursor); line_no counts from the first of them."""
    own = cursors.select("file", F.col("cursor").alias("start"), F.col("size").alias("end"), F.lit(max(1, n)).alias("head"))
    return range_lines(own, max_line_length, meter=meter).withColumnRenamed("n", "line_no").select(LINES)
