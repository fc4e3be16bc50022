"""Following growing logs with Structured Streaming: lines, records, searches and counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.criteria import Criteria
from tracewright.functions.parsers import classify, is_header, plain
from tracewright.functions.scalar import to_ts
from tracewright.operators.fold import FIELDS, MAX_CONTINUATION, RECORDS
from tracewright.sources.lines import MAX_LINE_LENGTH
from tracewright.sources.ranges import SLICE_BYTES
from tracewright.sources.stores import sizes
from tracewright.streaming.tail_source import AppendedLines

#: Records may be late by so much in time.
LATENESS = "300 seconds"
WINDOWS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}
_OPEN = "offset long, end_offset long, lines array<string>, truncated boolean"
_FOLDED = f"file string, {_OPEN}"
_FRAGMENT = f"file string, event string, {_OPEN}, begins boolean"
_FRAGMENT_COLUMNS = [x.split()[0] for x in _FRAGMENT.split(", ")]


def follow_lines(spark: SparkSession, path: str, start: str = "end", max_bytes: int | None = None, recursive: bool = False, max_line_length: int = MAX_LINE_LENGTH, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A stream of appended lines (event, file, offset, end_offset, raw, truncated); rotation is an event row.

    ``max_bytes`` bounds what a trigger takes of a file (None: all that is there); ``slice_bytes`` is what a task reads.
    """
    spark.dataSource.register(AppendedLines)
    options = {"path": path, "start": start, "recursive": str(recursive), "max_line_length": str(max_line_length), "slice_bytes": str(slice_bytes)}
    return spark.readStream.format("appended_lines").options(**options, **({} if max_bytes is None else {"max_bytes": str(max_bytes)})).load()


def drain(writer: DataStreamWriter, path: str, recursive: bool = False) -> int:
    """Run a stream over appended lines (of ``path``), trigger by trigger, until it has taken what is there now; the number of triggers.

    What is appended meanwhile is left. The writer needs a checkpoint location; a stream without ``max_bytes`` takes one trigger.
    """
    goal = {f: n for f, (n, _) in sizes(path, recursive, hidden=False).items()}
    done = 0
    while True:
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
        if run.lastProgress is None:
            return done
        done += 1
        source = json.loads(run.lastProgress.json)["sources"][0]
        begin, end = (json.loads(x["files"]) if x else {} for x in (source["startOffset"], source["endOffset"]))
        if begin == end or all(end.get(f, 0) >= n for f, n in goal.items()):
            return done


def follow_segments(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """A stream of the lines of rolled segments, files that don't grow any more."""
    reader = spark.readStream.option("lineSep", "\n")
    return (reader if max_bytes is None else reader.option("maxBytesPerTrigger", str(max_bytes))).text(path)


def follow_records(lines: DataFrame, parsers=None, max_continuation: int = MAX_CONTINUATION, timeout: str | None = None) -> DataFrame:
    """Records of a stream of lines. The open record of each file is kept as state across micro-batches.

    It comes out at the next header, at the limit of lines, on rotation, or after ``timeout`` without a line (given as
    a duration; None keeps it until then).

    A task finishes by itself the records whose header and end lie in the lines that it reads one after another. Only
    what is left at the edges of such runs (``fragments``) goes to the file's state, so a file's batch comes together
    nowhere, however large; what a state step holds grows with the runs and with lines that no header precedes. The
    lines are read twice for this, once for either.
    """
    wait = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        kept = state.get if state.exists else None
        now = (kept[0], kept[1], list(kept[2]), kept[3]) if kept is not None else None
        if state.hasTimedOut:
            out.append((key[0], *now))
            state.remove()
        else:
            # a batch's rows of one file come in any order; rotation begins a new file
            rows = pd.concat(list(frames))
            if (rows["event"] == "rotated").any() and now is not None:
                out.append((key[0], *now))
                now = None
            rows = rows[rows["event"] == "append"].sort_values("offset")
            done, now = _joined(rows[["begins", "offset", "end_offset", "lines", "truncated"]].itertuples(index=False), now, max_continuation)
            out += [(key[0], *x) for x in done]
            if now is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(now))
                if wait is not None:
                    state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["file", "offset", "end_offset", "lines", "truncated"])

    kind = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    at_edges = fragments(lines, False, parsers, max_continuation).groupBy("file").applyInPandasWithState(fold, _FOLDED, _OPEN, "append", kind)
    folded = fragments(lines, True, parsers, max_continuation).select(at_edges.columns).union(at_edges)
    first = F.col("lines")[0]
    head = F.coalesce(classify(first, parsers), plain(first))
    rows = folded.select("file", "offset", "end_offset", "lines", "truncated", F.inline(F.array(head)))
    rows = rows.select("file", "offset", "end_offset", F.array_join("lines", "\n").alias("raw"), "truncated", F.size("lines").alias("n_lines"), *FIELDS[:-1], F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))).alias("extra"))
    return rows.withColumn("ts", to_ts(F.col("datetime"))).select(RECORDS)


def fragments(lines: DataFrame, whole: bool, parsers=None, max_continuation: int = MAX_CONTINUATION) -> DataFrame:
    """Of the lines that a task reads one after another of a file: the ``whole`` records, or what is left beside them.

    Left are lines before a run's first header, one a row, and the last record of the run (``begins``), which later lines
    may go on with; rotations pass. A run ends where the next line isn't of the same file or doesn't begin where the
    last one ended, so lines that come in no order are all left, each as a run of its own.
    """
    own = lines.withColumn("is_header", is_header(F.col("raw"), parsers))
    own = own.select("file", "event", "offset", "end_offset", "raw", "is_header", F.col("truncated") if "truncated" in lines.columns else F.lit(False).alias("truncated"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = end = held = None
        for rows in frames:
            out: list[tuple] = []
            append = rows["event"].to_numpy() == "append"
            names, offset, ends = rows["file"].to_numpy(), rows["offset"].to_numpy(), rows["end_offset"].to_numpy()
            goes_on = np.zeros(len(rows), dtype=bool)
            goes_on[1:] = (names[1:] == names[:-1]) & (offset[1:] == ends[:-1]) & append[1:] & append[:-1]
            if len(rows):
                goes_on[0] = append[0] and file == names[0] and end == offset[0]
            begin = np.flatnonzero(np.concatenate([[True], ~goes_on[1:]])) if len(rows) else []
            for a, b in zip(begin, [*begin[1:], len(rows)]):
                if held is not None and not goes_on[a]:
                    out += [] if whole else [(file, "append", *held, True)]
                    held = None
                part = rows.iloc[a:b]
                file, end = (names[b - 1], ends[b - 1]) if append[a] else (None, None)
                if not append[a]:
                    out += [] if whole else [(x.file, x.event, x.offset, x.end_offset, [], False, False) for x in part.itertuples()]
                    continue
                headers = np.flatnonzero(part["is_header"].to_numpy(dtype=bool))
                lead = 0 if held is not None else int(headers[0]) if len(headers) else b - a
                if not whole:
                    out += [(x.file, "append", x.offset, x.end_offset, [x.raw], x.truncated, False) for x in part.iloc[:lead].itertuples()]
                if lead < b - a:
                    done, held = _folded_batch(part.iloc[lead:], held, max_continuation)
                    out += [(file, "append", *x, True) for x in done] if whole else []
            yield pd.DataFrame(out, columns=_FRAGMENT_COLUMNS)
        if held is not None and not whole:
            yield pd.DataFrame([(file, "append", *held, True)], columns=_FRAGMENT_COLUMNS)

    return own.mapInPandas(cut, _FRAGMENT)


def _joined(pieces: Iterator[tuple], held: tuple | None, max_continuation: int) -> tuple[list[tuple], tuple | None]:
    """A file's fragments (begins, offset, end_offset, lines, truncated) in order: finished records, and the one that stays open."""
    done: list[tuple] = []
    for begins, offset, end, own, cut in pieces:
        if held is not None and (begins or len(held[2]) > max_continuation):
            done.append(held)
            held = None
        held = (int(offset), int(end), list(own), bool(cut)) if held is None else (held[0], int(end), [*held[2], *own], bool(held[3] or cut))
    return done, held


def _folded_batch(rows: pd.DataFrame, held: tuple | None, max_continuation: int) -> tuple[list[tuple], tuple]:
    """A file's new lines in order: finished records (offset, end_offset, lines, truncated), and the one that stays open. ``held`` is the one that was."""
    header = rows["is_header"].to_numpy(dtype=bool)
    group = np.cumsum(header)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
    place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    if held is not None and not header[0]:  # the first group goes on with the open record
        place[group == 0] += len(held[2])
    starts = np.flatnonzero(place % (max_continuation + 1) == 0)
    raw, offset, end, cut = (rows[x].tolist() for x in ("raw", "offset", "end_offset", "truncated"))
    done: list[tuple] = []
    first = int(starts[0]) if len(starts) else len(rows)
    if held is not None:
        held = (held[0], end[first - 1] if first else held[1], held[2] + raw[:first], held[3] or any(cut[:first]))
        done.append(held)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        done.append((offset[a], end[b - 1], raw[a:b], any(cut[a:b])))
    return done[:-1], done[-1]


def search_stream(records: DataFrame, criteria: Criteria) -> DataFrame:
    """The records of a stream that match; the limit and cursors are a batch's."""
    return records.filter(criteria.predicate(cursor=False))


def count_stream(records: DataFrame, criteria: Criteria = Criteria(), bucket: str = "hour", lateness: str = LATENESS) -> DataFrame:
    """bucket_start, n of a stream's matches in tumbling windows; later records than ``lateness`` are dropped."""
    dated = search_stream(records, criteria).filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = dated.withWatermark("ts", lateness).groupBy(F.window("ts", WINDOWS[bucket]).alias("_window")).agg(F.count("*").alias("n"))
    return counted.select(F.col("_window.start").alias("bucket_start"), "n")


def count_undated(records: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """One row with the number of a stream's undated matches (complete mode)."""
    return search_stream(records, criteria).filter(F.col("ts").isNull()).agg(F.count("*").alias("n"))
