"""Physical lines with exact byte offsets, from text files of any size or from a text column.

Offsets are sums of line lengths. They are made in two steps so that one huge file is read by many tasks: a running sum
within every block (a file's split), and the blocks' totals, few rows, summed up along the file. Where lines are to be
folded (``headers``), the same pass tells headers apart, and the totals carry each block's last one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.functions.parsers import Parser, is_header
from tracewright.functions.scalar import cap_bytes, rstrip_eol

MAX_LINE_LENGTH = 32_768
LINES = ["file", "block", "line_no", "offset", "end_offset", "raw", "truncated"]
#: What lines made for folding have besides: whether a line is a header, and the line_no of the header it stands under (null above the first).
FOLDABLE = ["is_header", "header_line"]


def _placed(rows: DataFrame, order: str, headers: bool, held: Sequence[str] = ()) -> DataFrame:
    """Add line_no, offset and end_offset to rows (file, block, length, raw, ``order``, with ``headers`` is_header), and the file's bytes ``_all``.

    Rows and totals come from one shuffle by block. With headers the totals use all columns that the rows have (``held``
    are numbers besides), so Spark's plan shuffles once and uses that twice, and the source is read once.
    """
    own = Window.partitionBy("file", "block").orderBy(order)
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    nothing = F.lit(0).cast("long")
    if not headers:
        totals = rows.groupBy("file", "block").agg(F.count("*").alias("_lines"), F.sum("length").alias("_bytes"))
        rows = rows.withColumns({"_n": F.row_number().over(own).cast("long"), "_end": F.sum("length").over(running)})
    else:
        rows = rows.withColumns({"_n": F.row_number().over(own).cast("long"), "_end": F.sum("length").over(running)})
        rows = rows.withColumn("_own", F.last(F.when(F.col("is_header"), F.col("_n")), ignorenulls=True).over(running))
        widest = F.greatest(F.lit(0), F.max(F.octet_length("raw")), *map(F.max, held))
        totals = rows.groupBy("file", "block").agg(F.max("_n").alias("_lines"), F.max("_end").alias("_bytes"), F.max("_own").alias("_last"), widest.alias("_widest")).filter("_widest >= 0")
    base = totals.withColumns({"first_line": F.coalesce(F.sum("_lines").over(before), nothing), "first_byte": F.coalesce(F.sum("_bytes").over(before), nothing), "_all": F.sum("_bytes").over(Window.partitionBy("file"))})
    if headers:
        base = base.withColumn("_before", F.last(F.col("first_line") + F.col("_last"), ignorenulls=True).over(before))
    rows = rows.join(base.drop("_lines", "_bytes", "_last", "_widest"), ["file", "block"])
    rows = rows.withColumns({"line_no": F.col("first_line") + F.col("_n"), "end_offset": F.col("first_byte") + F.col("_end")}).withColumn("offset", F.col("end_offset") - F.col("length"))
    return rows.withColumn("header_line", F.coalesce(F.col("first_line") + F.col("_own"), "_before")) if headers else rows


def capped(rows: DataFrame, limit: int | None, headers: bool = False, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """raw, its length with the line break and, with ``headers``, whether it is a header, instead of ``content``."""
    text, _ = cap_bytes(F.col("content"), limit)
    rows = rows.withColumns({"length": F.octet_length("content").cast("long") + 1, "raw": rstrip_eol(text)}).drop("content")
    return rows.withColumn("is_header", is_header(F.col("raw"), None if parsers is None else list(parsers))) if headers else rows


def reached(limit: int | None) -> Column:
    """Whether a terminated line counts as cut: it has the limit's bytes or more."""
    return F.lit(False) if limit is None else F.col("length") > limit


def read_lines(spark: SparkSession, paths: str | list[str], max_line_length: int | None = MAX_LINE_LENGTH, headers: bool = False, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """Lines of text files (file, block, line_no, offset, end_offset, raw, truncated); a block is a split of the file.

    Line breaks are \\n alone; \\r and \\n at a line's end don't belong to ``raw``. A byte-order mark counts for offsets.
    A terminated line of just ``max_line_length`` bytes counts as cut, an unterminated one doesn't. ``headers`` prepares
    the lines for folding by the same ``parsers``.
    """
    source = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("value").alias("content"),
        F.monotonically_increasing_id().alias("_order"),
    )
    placed = _placed(capped(source, max_line_length, headers, parsers), "_order", headers, ["_size"])
    # the reader swallows a byte-order mark: then three bytes are missing (or two, without a last line break)
    mark = F.when((F.col("_size") - F.col("_all")).isin(3, 2), 3).otherwise(0)
    first = F.col("line_no") == 1
    open_end = F.col("end_offset") + mark > F.col("_size")
    placed = placed.withColumns({
        "offset": F.when(first, 0).otherwise(F.col("offset") + mark),
        "end_offset": F.least(F.col("end_offset") + mark, F.col("_size")),
        "truncated": reached(max_line_length) & ~(open_end & (F.col("length") - 1 <= (max_line_length or 0))),
    })
    return placed.select(*LINES, *FOLDABLE * headers)


def lines_from_table(df: DataFrame, file: Column | str, text: Column | str, order: list[Column | str] | None = None, max_line_length: int | None = MAX_LINE_LENGTH, block: Column | None = None, headers: bool = False, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """The same lines from a column of texts: each row's text is split at \\n and continues its file in the given order.

    Without an order every row is a file of its own name. ``block`` cuts a large file: rows of one block must be
    consecutive in the order, and blocks ascend with it.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = {f"_k{i}": as_col(c) for i, c in enumerate(order or [])}
    source = df.select(as_col(file).alias("file"), F.coalesce((block if block is not None else F.lit(0)).cast("long"), F.lit(0)).alias("block"), *(c.alias(k) for k, c in keys.items()), F.coalesce(as_col(text), F.lit("")).alias("_text"))
    rows = source.select("file", "block", *keys, F.posexplode(F.split("_text", "\n")).alias("_pos", "content"))
    rows = rows.withColumn("_order", F.struct(*keys, "_pos")).drop(*keys, "_pos")
    placed = _placed(capped(rows, max_line_length, headers, parsers), "_order", headers)
    return placed.withColumn("truncated", reached(max_line_length)).select(*LINES, *FOLDABLE * headers)


def read_range(lines: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines to fold so that records whose header lies in [start, end) come out; apply ``in_range`` to the records."""
    return lines if end is None else lines.filter(F.col("offset") < end)


def in_range(records: DataFrame, start: int = 0) -> DataFrame:
    """Records that begin at ``start`` or behind; one that began before is left out."""
    return records.filter(F.col("offset") >= start)


_sources: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_source(name: str, make: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Add or replace a source of lines; ``make(spark, config)`` returns them."""
    _sources[name] = make


def lines_of(spark: SparkSession, name: str, config: dict) -> DataFrame:
    if name not in _sources:
        raise ValueError(f"no source {name!r}; there are {', '.join(sorted(_sources)) or 'none'}")
    return _sources[name](spark, config)


register_source("files", lambda spark, config: read_lines(spark, config["paths"], config.get("max_line_length", MAX_LINE_LENGTH), config.get("headers", False)))
