"""Search over records: one limit over many files in a given order, oldest or newest first, resumable by cursor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.criteria import Criteria
from tracewright.sources.stores import written

#: Requested files in order, or with a cursor of their own each.
Files = Sequence[str] | Mapping[str, int]


def _with_order(df: DataFrame, files: Files | None, backward: bool = False) -> DataFrame:
    """Only the requested files, with ``file_ord``, their place (a repeated name has its first); files with cursors of their own from those on, or below."""
    if files is None:
        return df.withColumn("file_ord", F.lit(0).cast("long"))
    names = list(dict.fromkeys(files))
    asked = {"file": names, "file_ord": range(1, len(names) + 1)}
    if not isinstance(files, Mapping):
        return df.join(df.sparkSession.createDataFrame(pa.table(asked)), "file")
    asked["_cursor"] = [files[x] for x in names]
    own = df.join(df.sparkSession.createDataFrame(pa.table(asked)), "file")
    past = (F.col("_cursor") == 0) | (F.col("offset") < F.col("_cursor")) if backward else F.col("offset") >= F.col("_cursor")
    return own.filter(past).drop("_cursor")


def _offset_order(criteria: Criteria) -> list[Column]:
    return [F.col("file_ord"), F.desc("offset") if criteria.backward else F.asc("offset"), F.col("file")]


def search(records: DataFrame, criteria: Criteria, files: Files | None = None) -> DataFrame:
    """The first matches up to the limit: file by file in the given order, within a file by offset. No global sort: a top-n per task, then one of those.

    ``files`` may be a mapping to cursors: a search over many files goes on where ``search_status`` says each was left.
    """
    found = _with_order(records.filter(criteria.predicate()), files, criteria.backward)
    return found.orderBy(*_offset_order(criteria)).limit(criteria.most).drop("file_ord")


def search_status(files: DataFrame, records: DataFrame, criteria: Criteria) -> DataFrame:
    """Per requested file (file, file_ord, size): n, complete, truncated, next_cursor, range_start, range_end.

    The budget of a file is what the files before it left. A forward search is incomplete as soon as the budget is
    used up, a backward one only if there was more; files behind that aren't scanned. The matches' places are written
    once: what is counted and what is ranked, at most the limit in each file, is read from there.
    """
    hits = written(records.filter(criteria.predicate()).select("file", "offset", "end_offset"), "matches")
    counts = hits.groupBy("file").agg(F.count("*").alias("cnt"))
    order = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row for each requested file
    rows = files.select("file", "file_ord", "size").join(counts, "file", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.sum("cnt").over(order), F.lit(0)))
    limit = F.lit(criteria.most).cast("long")
    scanned = F.col("before") < limit
    over = F.col("before") + F.col("cnt")
    hit = scanned & (over > limit if criteria.backward else over >= limit)
    rows = rows.withColumns({"n": F.when(scanned, F.least("cnt", limit - F.col("before"))).otherwise(0), "scanned": scanned, "hit": hit})
    # the offset that the last returned record of the file leaves off at
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("offset") if criteria.backward else F.asc("offset")))
    first = hits.withColumn("_place", place).filter(F.col("_place") <= criteria.most)
    stops = first.join(rows.filter("hit").select("file", "n"), "file").filter("_place = n").select("file", F.col("offset" if criteria.backward else "end_offset").alias("stop"))
    rows = rows.join(stops, "file", "left")
    top = F.col("size") if criteria.end_offset is None else F.least("size", F.lit(criteria.end_offset))
    cursor = F.lit(criteria.from_offset).cast("long")
    low, high = (F.lit(0).cast("long"), top) if criteria.backward else (F.least(top, cursor), top)
    return rows.select(
        "file", "file_ord", F.col("n").cast("long").alias("n"),
        (F.col("scanned") & ~F.col("hit")).alias("complete"),
        (F.col("hit") | ~F.col("scanned")).alias("truncated"),
        F.when(~F.col("scanned"), cursor).when(F.col("hit"), F.col("stop")).alias("next_cursor"),
        F.when(F.col("scanned"), low).alias("range_start"),
        F.when(F.col("scanned"), high).alias("range_end"),
    )


def newest_per_file(records: DataFrame, criteria: Criteria, k: int) -> DataFrame:
    """The newest k matches of every file; the group limit is applied before the shuffle."""
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("offset")))
    return records.filter(criteria.predicate()).withColumn("place", last).filter(F.col("place") <= k)


def attribute_files(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with their file's columns; a file without a match appears once."""
    return files.join(matches, "file", "left")
