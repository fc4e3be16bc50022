"""Counts of matching records per time bucket, in all, and per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.criteria import Criteria
from tracewright.functions.scalar import BUCKETS, bucket_label, check_bucket, coarsen_label

MAX_BUCKETS = 10_000


def count_error(bucket: Column, backward: Column, from_offset: Column) -> Column:
    """What is wrong with a count's arguments, null where nothing is: its bucket, or a backward cursor, which counts don't have."""
    return F.when(~F.coalesce(bucket.isin(list(BUCKETS)), F.lit(False)), "bucket").when(backward & (from_offset > 0), "cursor")


def check_count(criteria: Criteria, bucket: str) -> None:
    """Counts have no backward cursor."""
    check_bucket(bucket)
    if criteria.backward and criteria.from_offset > 0:
        raise ValueError("a count takes no backward cursor")


def _matches(records: DataFrame, criteria: Criteria) -> DataFrame:
    return records.filter(criteria.predicate()).select("file", "ts")


def count_buckets(records: DataFrame, criteria: Criteria = Criteria(), bucket: str = "hour") -> DataFrame:
    """bucket, n in ascending order; undated records are in no bucket, empty buckets are absent, the limit doesn't count."""
    check_count(criteria, bucket)
    dated = _matches(records, criteria).filter(F.col("ts").isNotNull())
    return dated.groupBy(bucket_label(F.col("ts"), bucket).alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")


def count_summary(records: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """One row: total, undated (part of total), first and last in unix seconds."""
    seconds = F.unix_timestamp("ts")
    return _matches(records, criteria).agg(F.count("*").alias("total"), F.count_if(F.col("ts").isNull()).alias("undated"), F.min(seconds).alias("first"), F.max(seconds).alias("last"))


def count_per_file(files: DataFrame, records: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Per file (file, size): total, also 0, and the counted range."""
    totals = _matches(records, criteria).groupBy("file").agg(F.count("*").alias("total"))
    end = F.col("size") if criteria.end_offset is None else F.least("size", F.lit(criteria.end_offset))
    return files.join(totals, "file", "left").select("file", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.least(end, F.lit(criteria.from_offset)).cast("long").alias("range_start"), end.cast("long").alias("range_end"))


def count_auto(records: DataFrame, criteria: Criteria = Criteria(), bucket: str = "minute", max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """bucket, n and ``used``: the finest bucket, from the asked one on, that has no more than ``max_buckets`` labels (days always do).

    Records are grouped once; coarser labels are made from the groups.
    """
    check_count(criteria, bucket)
    order = ["minute", "hour", "day"]
    fine = count_buckets(records, criteria, bucket)
    wanted = order[order.index(bucket):]
    labels = {b: F.col("bucket") if b == bucket else coarsen_label(F.col("bucket"), b) for b in wanted}
    sizes = fine.agg(*(F.count_distinct(labels[b]).alias(b) for b in wanted))
    used = F.lit(wanted[-1])
    for b in reversed(wanted[:-1]):
        used = F.when(F.col(b) <= max_buckets, b).otherwise(used)
    chosen = sizes.select(used.alias("used")).scalar()
    label = F.coalesce(*(F.when(chosen == b, labels[b]) for b in wanted))
    return fine.groupBy(label.alias("bucket")).agg(F.sum("n").alias("n"), F.first(chosen).alias("used")).orderBy("bucket")


def bucket_map(counts: DataFrame) -> DataFrame:
    """One row with ``buckets``: the counts as a map in ascending order."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n")))).alias("buckets"))
