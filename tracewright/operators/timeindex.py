"""Byte ranges for time windows, and a block-level time index (zone map) that lets a search read matching blocks only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.functions.criteria import Criteria
from tracewright.functions.parsers import Parser, header_time
from tracewright.functions.scalar import to_ts
from tracewright.operators.fold import MAX_CONTINUATION, fold_records, line_keys
from tracewright.sources.files import read_records
from tracewright.sources.ranges import read_ranges
from tracewright.sources.stores import held, written

MARGIN = 300
#: Up to so many ranges a read of kept records has as predicates; days alone prune beyond.
MOST_PREDICATES = 200
PROBED_BYTES = 1 << 20


def time_range(files: DataFrame, records: DataFrame, date_from: dt.datetime | None, date_to: dt.datetime | None, margin: int = MARGIN) -> DataFrame:
    """Per file (file, size): start and end of the bytes that hold the window, wide rather than narrow.

    start is the first header at or after ``date_from`` less the margin, end the first one behind ``date_to`` plus the
    margin; without a dated header in the first MiB it is the whole file. Headers' places and times are written once,
    for they are looked at three times.
    """
    stamp = F.unix_timestamp("ts")
    headers = written(records.filter(F.col("parser") != "plain").select("file", "offset", stamp.alias("t")), "headers")
    low = None if date_from is None else int(date_from.timestamp()) - margin
    high = None if date_to is None else int(date_to.timestamp()) + margin
    at_least = F.lit(False) if low is None else F.col("t") >= low
    behind = F.lit(False) if high is None else F.col("t") > high
    until = F.lit(False) if high is None else F.col("t") <= high
    marks = headers.groupBy("file").agg(
        F.min(F.when(at_least, F.col("offset"))).alias("ge"),
        F.max(F.when(until, F.col("offset"))).alias("le"),
        F.coalesce(F.bool_or(F.col("t").isNotNull() & (F.col("offset") < PROBED_BYTES)), F.lit(False)).alias("dated"),
    )
    own = headers.join(marks, "file")
    before = F.lit(False) if low is None else (F.col("t") < low) & (F.col("offset") < F.coalesce("ge", F.lit((1 << 63) - 1)))
    floors = own.groupBy("file").agg(F.max(F.when(before, F.col("offset"))).alias("floor"), F.min(F.when(behind & (F.col("offset") > F.coalesce("le", F.lit(-1))), F.col("offset"))).alias("gt"))
    starts = headers.join(floors, "file").filter(F.col("floor").isNotNull() & (F.col("offset") > F.col("floor"))).groupBy("file").agg(F.min("offset").alias("after"))
    rows = files.select("file", "size").join(marks, "file", "left").join(floors, "file", "left").join(starts, "file", "left")
    dated = F.coalesce("dated", F.lit(False))
    start = F.when(~dated | F.col("floor").isNull(), 0).otherwise(F.coalesce("after", "size"))
    end = F.when(~dated | F.lit(high is None), F.col("size")).otherwise(F.coalesce("gt", "size"))
    return rows.select("file", F.least(start, end).cast("long").alias("start"), end.cast("long").alias("end"))


def time_index(records: DataFrame, block_bytes: int = 128 << 20) -> DataFrame:
    """The zone map: per file and block the time span, the number of headers, of undated ones, and the first and last header.

    ``untimed`` counts all records without a time, also those without a header, and ``first_record`` is the block's
    first record of any kind: by these a window's search finds undated records as an unpruned one does.
    """
    block = F.floor(F.col("offset") / block_bytes).alias("block")
    headed = F.col("parser") != "plain"
    of_header = lambda c: F.when(headed, c)
    return records.groupBy("file", block).agg(
        F.min(of_header(F.col("ts"))).alias("min_ts"), F.max(of_header(F.col("ts"))).alias("max_ts"), F.count_if(headed).alias("headers"), F.count_if(headed & F.col("ts").isNull()).alias("undated"),
        F.min(of_header(F.col("offset"))).alias("first_header"), F.max(of_header(F.col("offset"))).alias("last_header"), F.count_if(F.col("ts").isNull()).alias("untimed"), F.min("offset").alias("first_record"),
    )


def index_lines(lines: DataFrame, block_bytes: int = 128 << 20, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION) -> DataFrame:
    """``time_index`` of the lines' records, which aren't put together for it.

    A record lies where its first line does and has the time that this line's header says. So first lines are told by
    their numbers, of headers the time alone is read, and lines meet by block, as sums.
    """
    keyed = line_keys(lines, parsers, max_continuation)
    place = F.col("line_no") - F.col("head")
    begins = keyed.filter((place if max_continuation is None else place % (max_continuation + 1)) == 0)
    time = F.when(F.col("is_header"), header_time("raw", None if parsers is None else list(parsers)))
    own = begins.select("file", "offset", F.when(F.col("is_header"), "headed").otherwise("plain").alias("parser"), to_ts(time).alias("ts"))
    return time_index(own, block_bytes)


def matching_blocks(index: DataFrame, criteria: Criteria, margin: int = MARGIN) -> DataFrame:
    """(file, block) of the blocks whose span meets the criteria's window, or which hold records without a time: all that a search can return lies there."""
    low, high = criteria.bounds()
    keep = F.col("min_ts").isNotNull()
    if low is not None:
        keep &= F.col("max_ts") >= F.lit(low - dt.timedelta(seconds=margin))
    if high is not None:
        keep &= F.col("min_ts") <= F.lit(high + dt.timedelta(seconds=margin))
    return index.filter(keep | (F.col("untimed") > 0)).select("file", "block")


def matching_ranges(index: DataFrame, files: DataFrame, criteria: Criteria, margin: int = MARGIN) -> DataFrame:
    """(file, start, end): the bytes of the records that begin in matching blocks, blocks in a row being one range; files: file, size."""
    by_block = Window.partitionBy("file").orderBy("block")  # a row for each block
    ends = index.withColumn("_next", F.lead("first_record").over(by_block))
    found = ends.join(matching_blocks(index, criteria, margin), ["file", "block"], "left_semi").join(files.select("file", "size"), "file")
    found = found.select("file", "block", F.col("first_record").alias("start"), F.coalesce("_next", "size").alias("end"))
    apart = F.coalesce(F.lag("end").over(by_block) < F.col("start"), F.lit(True))
    found = found.withColumn("_range", F.sum(apart.cast("int")).over(by_block))
    return found.groupBy("file", "_range").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_range")


def search_text(spark: SparkSession, index: DataFrame, files: DataFrame, criteria: Criteria, parsers: Sequence[Parser] | None = None, margin: int = MARGIN, meter: Accumulator | None = None) -> DataFrame:
    """Matches in text files, of which only the byte ranges are read that a kept time index names; the same as a search of all."""
    ranges = held(matching_ranges(index, files, criteria, margin), "ranges")
    return fold_records(read_ranges(ranges, headers=True, parsers=parsers, meter=meter), parsers).filter(criteria.predicate())


def search_kept(spark: SparkSession, path: str, index: DataFrame, files: DataFrame, criteria: Criteria, margin: int = MARGIN) -> DataFrame:
    """Matches in records kept by ``write_records``, of which only the days and row groups are read that a kept time index names.

    A few ranges are predicates that skip row groups, more of them are not; the result is the same, for all that passes
    the criteria lies in the ranges.
    """
    records = read_records(spark, path, criteria)
    few = matching_ranges(index, files, criteria, margin).limit(MOST_PREDICATES + 1).collect()
    if len(few) <= MOST_PREDICATES:
        inside = [(F.col("file") == r["file"]) & (F.col("offset") >= r["start"]) & (F.col("offset") < r["end"]) for r in few]
        records = records.filter(reduce(lambda x, y: x | y, inside, F.lit(False)))
    return records.filter(criteria.predicate())


def search_window(records: DataFrame, index: DataFrame, criteria: Criteria, block_bytes: int = 128 << 20, margin: int = MARGIN) -> DataFrame:
    """Matches in any records in the blocks that the index names; ``search_text`` and ``search_kept`` read no others."""
    records = records if "block" in records.columns else records.withColumn("block", F.floor(F.col("offset") / block_bytes))
    return records.join(matching_blocks(index, criteria, margin), ["file", "block"], "left_semi").filter(criteria.predicate()).drop("block")
