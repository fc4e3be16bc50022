"""Folding lines into records: a header and the lines that continue it.

A file's lines lie in blocks. Within a block the last header is found by a window; what a block inherits comes from a
row per block (its last header), carried along the file. Sources do both in the pass that places lines, if they are
asked for ``headers``; other lines get it here. Lines then belong to (file, header, chunk), chunks being cuts
after ``max_continuation`` lines, and are brought together by that key. Lines are only told apart as headers and
others; what a header says is read once, from the assembled record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.functions.parsers import PARSED, Parser, classify, is_header, plain, reading
from tracewright.functions.scalar import to_ts

MAX_CONTINUATION = 200
FIELDS = ["parser", "level", "datetime", "channel", "message", "context", "extra"]
RECORDS = ["file", "offset", "end_offset", "raw", "truncated", "n_lines", *FIELDS, "ts"]


def classify_lines(lines: DataFrame, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """``lines`` with ``parsed``: what the first parser that claims the line reads, null for a continuation."""
    return lines.withColumn("parsed", classify(F.col("raw"), None if parsers is None else list(parsers)))


def _with_headers(lines: DataFrame, parsers: Sequence[Parser] | None) -> DataFrame:
    """``lines`` with ``is_header`` and ``header_line``, the line_no of the header they stand under (null above the first)."""
    lines = lines.withColumn("is_header", is_header(F.col("raw"), None if parsers is None else list(parsers)))
    within = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_own", F.last(F.when(F.col("is_header"), F.col("line_no")), ignorenulls=True).over(within))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = lines.groupBy("file", "block").agg(F.max(F.when(F.col("is_header"), F.col("line_no"))).alias("_last"))
    carried = last.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    return lines.join(carried, ["file", "block"]).withColumn("header_line", F.coalesce("_own", "_before"))


def line_keys(lines: DataFrame, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION, plain_records: bool = True) -> DataFrame:
    """Lines with ``is_header`` and the record they belong to: ``head`` (line_no of its group's first line) and ``chunk``."""
    if "header_line" not in lines.columns:
        lines = _with_headers(lines, parsers)
    # lines above the first header are one group that begins at line 1
    lines = lines.withColumn("head", F.coalesce("header_line", F.lit(1).cast("long")))
    at = F.col("line_no") - F.col("head")
    chunk = F.lit(0).cast("long") if max_continuation is None else F.floor(at / (max_continuation + 1))
    lines = lines.withColumn("chunk", chunk)
    if not plain_records:  # a line of no header's record stands alone
        alone = F.col("header_line").isNull() | (F.col("chunk") > 0)
        lines = lines.withColumns({"head": F.when(alone, F.col("line_no")).otherwise(F.col("head")), "chunk": F.when(alone, 0).otherwise(F.col("chunk"))})
    return lines


def fold_records(lines: DataFrame, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION, plain_records: bool = True) -> DataFrame:
    """Records of the lines, at most ``max_continuation`` continuation lines each; the rest makes plain records of the same size.

    ``plain_records=False`` leaves lines without a header as rows of their own without anything parsed.
    """
    return _records(line_keys(lines, parsers, max_continuation, plain_records), parsers, plain_records)


def _records(keyed: DataFrame, parsers: Sequence[Parser] | None, plain_records: bool) -> DataFrame:
    """A row for each (file, head, chunk)."""
    line = F.struct("line_no", "raw")
    grouped = keyed.groupBy("file", "head", "chunk").agg(
        F.min("offset").alias("offset"),
        F.max("end_offset").alias("end_offset"),
        F.transform(F.sort_array(F.collect_list(line)), lambda x: x["raw"]).alias("_raws"),
        F.bool_or("truncated").alias("truncated"),
        F.bool_or("is_header").alias("_headed"),
    )
    first = F.col("_raws")[0]
    none = F.lit(None).cast(PARSED)
    head = F.when(F.col("_headed"), reading("_raws[0]", None if parsers is None else list(parsers))).otherwise(plain(first) if plain_records else none)
    # a generator of one row, so that the header is read once and not once for each of its fields
    rows = grouped.select("file", "offset", "end_offset", "truncated", "_raws", F.inline(F.array(head)))
    rows = rows.select(
        "file", "offset", "end_offset", F.array_join("_raws", "\n").alias("raw"), "truncated", F.size("_raws").alias("n_lines"),
        *FIELDS[:-1], F.slice("_raws", 2, F.greatest(F.size("_raws"), F.lit(1))).alias("extra"),
    )
    return rows.withColumn("ts", to_ts(F.col("datetime"))).select(RECORDS)


def record_bounds(lines: DataFrame, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION) -> DataFrame:
    """file, offset and end_offset of ``fold_records``' records: sums of lines, whose texts are neither held nor read."""
    keyed = line_keys(lines, parsers, max_continuation)
    return keyed.groupBy("file", "head", "chunk").agg(F.min("offset").alias("offset"), F.max("end_offset").alias("end_offset")).select("file", "offset", "end_offset")


def record_at(records: DataFrame, probes: DataFrame, block_bytes: int = 64 << 20) -> DataFrame:
    """The record that holds each probe's byte (file, byte): the probes with offset and end_offset, null where none does.

    Probes and records meet by a window over both, ordered by byte, within ``block_bytes`` of a file; the record that
    reaches into a block comes from a row per block. No range join, and no file in one task. Of a record its two offsets
    alone are needed (``record_bounds``), so a row that is sorted is a few numbers.
    """
    none = F.lit(None).cast("long")
    both = records.select("file", F.col("offset").alias("_at"), F.col("end_offset").alias("_end")).unionByName(probes.select("file", F.col("byte").cast("long").alias("_at"), none.alias("_end")).filter("_at is not null"))
    both = both.withColumn("_block", F.floor(F.col("_at") / block_bytes))
    record = F.when(F.col("_end").isNotNull(), F.struct(F.col("_at").alias("offset"), F.col("_end").alias("end_offset")))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("file", "_block").agg(F.max(F.when(F.col("_end").isNotNull(), F.col("_at"))).alias("_at"), F.max("_end").alias("_end"))
    carried = carried.select("file", "_block", F.last(record, ignorenulls=True).over(before).alias("_before"))
    order = Window.partitionBy("file", "_block").orderBy("_at", F.asc_nulls_last("_end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_own", F.last(record, ignorenulls=True).over(order)).filter(F.col("_end").isNull()).join(carried, ["file", "_block"])
    met = met.withColumn("_found", F.coalesce("_own", "_before"))
    inside = F.col("_at") < F.col("_found.end_offset")
    return met.select("file", F.col("_at").alias("byte"), F.when(inside, F.col("_found.offset")).alias("offset"), F.when(inside, F.col("_found.end_offset")).alias("end_offset"))


def line_hits_to_records(lines: DataFrame, hit, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION) -> DataFrame:
    """The records that hold a line for which ``hit`` (a predicate on a line's columns) is true, each once."""
    keyed = line_keys(lines, parsers, max_continuation)
    touched = keyed.filter(hit).select("file", "head", "chunk").distinct()
    return _records(keyed.join(touched, ["file", "head", "chunk"], "left_semi"), parsers, True)
