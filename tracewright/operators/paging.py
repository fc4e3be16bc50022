"""Tails and pages of physical lines, folded as a batch of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.functions.parsers import is_header
from tracewright.operators.fold import fold_records
from tracewright.sources.lines import FOLDABLE, LINES
from tracewright.sources.ranges import range_lines, read_after, read_before
from tracewright.sources.stores import held


#: Spark keeps so many rows of a group in each task before it shuffles (spark.sql.optimizer.windowGroupLimitThreshold's default).
GROUP_LIMIT = 1000


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of every file, by their numbers, from one pass: each task passes on but its own last ones of a file.

    Of more lines than Spark limits before a shuffle, a row for each file says where they begin.
    """
    if n <= GROUP_LIMIT:
        return _ranked(lines, F.desc("line_no"), n)
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_end"))
    return lines.join(ends, "file").filter(F.col("line_no") > F.col("_end") - n).drop("_end")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every file, likewise."""
    if n <= GROUP_LIMIT:
        return _ranked(lines, F.asc("line_no"), n)
    begins = lines.groupBy("file").agg(F.min("line_no").alias("_begin"))
    return lines.join(begins, "file").filter(F.col("line_no") < F.col("_begin") + n).drop("_begin")


def _ranked(lines: DataFrame, order, n: int) -> DataFrame:
    return lines.withColumn("_rank", F.row_number().over(Window.partitionBy("file").orderBy(order))).filter(F.col("_rank") <= n).drop("_rank")


def fold_batch(lines: DataFrame, parsers=None) -> DataFrame:
    """Records of some lines of each file, without a limit on continuation lines; a leading continuation is a plain record."""
    # a batch is small: it is numbered anew, and its headers are found, by one window over each file's
    by_offset = Window.partitionBy("file").orderBy("offset")
    own = lines.drop(*FOLDABLE).withColumn("is_header", is_header(F.col("raw"), parsers))
    own = own.withColumn("line_no", F.row_number().over(by_offset).cast("long"))
    header = F.last(F.when(F.col("is_header"), F.col("line_no")), ignorenulls=True).over(by_offset.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fold_records(own.withColumn("header_line", header), parsers, max_continuation=None)


def tail(lines: DataFrame, n: int = 100, parsers=None) -> DataFrame:
    """The last n lines of every file, as records in file order."""
    return fold_batch(last_lines(lines, n), parsers)


def tail_status(lines: DataFrame, n: int = 100) -> DataFrame:
    """Per file: next_cursor (its size), previous_cursor (the batch's first offset, null at the start), count of lines."""
    own = last_lines(lines, n).groupBy("file").agg(F.min("offset").alias("_low"), F.max("end_offset").alias("next_cursor"), F.count("*").alias("count"))
    return own.select("file", "next_cursor", F.when(F.col("_low") > 0, F.col("_low")).alias("previous_cursor"), "count")


def page_lines(lines: DataFrame, cursor: int | None = None, limit: int = 200, direction: str = "next", compat: bool = False) -> DataFrame:
    """The lines of every file's page: ``limit`` of them from the cursor on, or before it (None is the start or the end).

    ``compat`` keeps an oddity of previous pages: with fewer lines above the cursor than ``limit`` the page still has
    ``limit`` lines, from the file's start on and past the cursor.
    """
    if direction == "next":
        return first_lines(lines.filter(F.col("offset") >= (cursor or 0)), limit)
    above = lines if cursor is None else lines.filter(F.col("offset") < cursor)
    page = last_lines(above, limit)
    if not compat or cursor is None:
        return page
    short = above.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") < limit).select("file")
    return page.join(short, "file", "left_anti").unionByName(first_lines(lines, limit).join(short, "file", "left_semi"))


def page(lines: DataFrame, cursor: int | None = None, limit: int = 200, direction: str = "next", parsers=None, compat: bool = False) -> DataFrame:
    """The page's records."""
    return fold_batch(page_lines(lines, cursor, limit, direction, compat), parsers)


def page_text(files: DataFrame, limit: int = 200, direction: str = "next", parsers=None, meter=None) -> DataFrame:
    """The page's records of text files (file, size, cursor), of which the page's lines alone are read; as ``page`` from these cursors (a null one is the start or the end)."""
    if direction == "next":
        return fold_batch(read_after(files.withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("long"))), limit, meter=meter), parsers)
    return fold_batch(read_before(files.withColumn("cursor", F.least(F.coalesce("cursor", "size"), "size")), limit, meter=meter), parsers)


def line_index(lines: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """Per file and block of bytes the first line that begins in it (its number and offset), to be kept for jumps to pages."""
    return lines.groupBy("file", F.floor(F.col("offset") / block_bytes).alias("block")).agg(F.min("line_no").alias("first_line"), F.min("offset").alias("first_offset"))


def numbered_page(index: DataFrame, files: DataFrame, number: int, page_size: int = 200, meter=None) -> DataFrame:
    """The lines of every file's page ``number`` (from 0), read from the block where the page begins, by a kept ``line_index``; files: file, size."""
    wanted = number * page_size + 1
    last = index.filter(F.col("first_line") <= wanted).groupBy("file").agg(F.max(F.struct("first_line", "first_offset")).alias("_at"))
    begins = files.select("file", "size").join(last, "file").select("file", F.col("_at.first_line").alias("_line"), F.col("_at.first_offset").alias("start"), F.col("size").alias("end"))
    # a row for each file; looked up once, for an index may be costly to make
    begins = held(begins.withColumns({"head": F.lit(wanted + page_size) - F.col("_line"), "key": F.col("_line")}), "pages")
    lines = range_lines(begins, meter=meter).withColumn("line_no", F.col("key") + F.col("n") - 1)
    return lines.filter(F.col("line_no") >= wanted).select(LINES)


def page_status(lines: DataFrame, cursor: int | None = None, limit: int = 200, direction: str = "next") -> DataFrame:
    """Per file: next_cursor (null at the end), previous_cursor (null at byte 0), file_size, reached_start, reached_end, count."""
    own = page_lines(lines, cursor, limit, direction).groupBy("file").agg(F.min("offset").alias("low"), F.max("end_offset").alias("high"), F.count("*").alias("count"))
    sizes = lines.groupBy("file").agg(F.max("end_offset").alias("file_size"))
    rows = sizes.join(own, "file", "left").withColumns({"at_start": F.col("low") == 0, "at_end": F.coalesce(F.col("high") >= F.col("file_size"), F.lit(True))})
    return rows.select("file", F.when(~F.col("at_end"), F.col("high")).alias("next_cursor"), F.when(F.col("low") > 0, F.col("low")).alias("previous_cursor"), "file_size", F.coalesce("at_start", F.lit(False)).alias("reached_start"), F.col("at_end").alias("reached_end"), F.coalesce("count", F.lit(0)).alias("count"))


def page_index(lines: DataFrame, page_size: int = 200) -> DataFrame:
    """Every page of every file: page (from 0), start, end, lines. Line numbers come with the lines, so pages are a plain grouping."""
    number = F.floor((F.col("line_no") - 1) / page_size).alias("page")
    return lines.groupBy("file", number).agg(F.min("offset").alias("start"), F.max("end_offset").alias("end"), F.count("*").alias("lines"))
