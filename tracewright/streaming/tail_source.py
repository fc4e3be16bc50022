"""A streaming source of lines appended to files. Spark's file source sees new files, not appended bytes.

Its offset is a byte per file, got from a listing: the driver reads no contents. A trigger's partitions are byte ranges
of bounded size, which executors read; a range owns the lines whose line break lies in it. Its reader looks back for the
first one's start only if there is one, and holds no more than a line's cap, so a line of any length costs its bytes once
and an unfinished line comes with the range in which it ends.

A trigger takes all that is there, or with ``max_bytes`` at most so many bytes of a file. Spark's availableNow is one
trigger of such a source: then all that was there when it started comes at once, in many ranges; ``drain`` in ``follow``
repeats bounded triggers up to that end. The checkpoint keeps the offset, so nothing is lost
or sent twice over a restart. A file that has become shorter than its offset was rotated: an event row says so and
reading restarts at byte 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracewright.sources.lines import MAX_LINE_LENGTH
from tracewright.sources.ranges import SLICE_BYTES, line_start, lines_between, next_start, rows_of
from tracewright.sources.stores import file_system, sizes

SCHEMA = "event string, file string, offset long, end_offset long, raw string, truncated boolean"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, rotated: bool):
        self.file, self.start, self.end, self.rotated = file, start, end, rotated


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = options.get("start", "end")
        self.max_bytes = int(options["max_bytes"]) if "max_bytes" in options else None
        self.slice_bytes = int(options.get("slice_bytes", SLICE_BYTES))
        self.limit = int(options.get("max_line_length", MAX_LINE_LENGTH))
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.now: dict[str, int] | None = None

    def _sizes(self) -> dict[str, int]:
        return {f: n for f, (n, _) in sizes(self.path, self.recursive, hidden=False).items()}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({f: n if self.start == "end" else 0 for f, n in self._sizes().items()})}

    def latestOffset(self) -> dict:
        if self.now is None:
            self.now = json.loads(self.initialOffset()["files"])
        after = {}
        for f, size in self._sizes().items():
            at = self.now.get(f, 0)
            after[f] = size if self.max_bytes is None else min(size, (0 if size < at else at) + self.max_bytes)
        self.now = after
        return {"files": json.dumps(after)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.now = after
        out: list[InputPartition] = []
        for f, b in after.items():
            a = before.get(f, 0)
            rotated = b < a
            for low in range(0 if rotated else a, b, self.slice_bytes):
                out.append(_Range(f, low, min(low + self.slice_bytes, b), False))
            if rotated:
                out.append(_Range(f, 0, 0, True))
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.rotated:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(("rotated", part.file, 0, 0, None, False), _KINDS)], _NAMES)
            return
        fs, path = file_system(part.file)
        with fs.open_input_file(path) as f:
            end = min(part.end, f.size())
            first = next_start(f, part.start + 1, end + 1)  # behind the first line break in the range
            if first is None:
                return
            # the line that this line break ends, then all that end in the range
            for some in lines_between(f, line_start(f, first - 1), end, end, self.limit):
                own = [x for x in some if x[3]]
                if not own:
                    continue
                raw, cut = rows_of(own, self.limit)
                columns = (["append"] * len(own), [part.file] * len(own), [x[0] for x in own], [x[1] for x in own], raw, cut)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _KINDS)], _NAMES)


class AppendedLines(DataSource):
    """``spark.readStream.format("appended_lines")`` with options path (a file, folder or glob), recursive, start (``begin`` or ``end``), max_bytes (of a file in a trigger), slice_bytes (of a range) and max_line_length."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
