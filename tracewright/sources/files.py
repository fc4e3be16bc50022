"""Listing log files, export classes, and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.functions.criteria import Criteria
from tracewright.functions.scalar import clamp_limit, file_identifier, fingerprint, size_human
from tracewright.operators.paging import last_lines
from tracewright.sources.stores import file_system, held

EXTENSIONS, HIDDEN = ("log", "txt"), ("*.key", "*.pem", ".env*")
MB = 1 << 20
#: A listing goes so many levels of folders down, each by at most so many tasks.
MOST_LEVELS, MOST_TASKS = 200, 1000


def glob_pattern(glob: str) -> str:
    """A case-folded, anchored pattern for a file name's glob."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def list_files(spark: SparkSession, roots: str | list[str], extensions: tuple[str, ...] = EXTENSIONS, hidden: tuple[str, ...] = HIDDEN, dotfiles: bool = False, driver: str = "local") -> DataFrame:
    """All files below the roots with one of the extensions (none given: all), newest first; contents aren't read.

    Spark's own listing never shows names that begin with a dot or an underscore; with ``dotfiles`` folders are listed
    level by level instead, each level's by tasks.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    if dotfiles:
        own = F.regexp_replace("path", r"^file:/*", "/")
        base = F.rtrim(F.regexp_replace("root", r"^file:/*", "/"), F.lit("/"))
        inner = F.expr("substr(_own, length(_base) + 2)")
        files = listed(spark, roots).withColumns({"_own": own, "_base": base}).select(F.col("_own").alias("path"), F.when(F.col("_own") == F.col("_base"), F.substring_index("_own", "/", -1)).otherwise(inner).alias("relative_path"), "modificationTime", "length")
    else:
        found = []
        for root in roots:
            seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
            base = re.sub(r"^file:/*", "/", root).rstrip("/")
            own = F.regexp_replace("path", r"^file:/*", "/")
            found.append(seen.withColumns({"path": own, "relative_path": F.regexp_replace(own, f"^{re.escape(base)}/", "")}))
        files = reduce(DataFrame.unionByName, found)
    return select_files(files.dropDuplicates(["path"]), extensions, hidden, dotfiles, driver).orderBy(F.desc("last_modified"), "path")


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file below the roots: root, path, modificationTime, length. A round lists the folders of one level, dealt to tasks."""
    level = spark.createDataFrame([(x, x) for x in roots], "root string, path string")
    found, folders = [], len(roots)
    for _ in range(MOST_LEVELS):
        entries = held(level.repartition(min(folders, MOST_TASKS)).mapInArrow(_entries, "root string, path string, folder boolean, modificationTime timestamp, length long"), "listing")
        found.append(entries.filter("not folder").drop("folder"))
        level = entries.filter("folder").select("root", "path")
        folders = level.count()
        if not folders:
            return reduce(DataFrame.unionByName, found)
    raise ValueError(f"folders lie deeper than {MOST_LEVELS} levels; a link may lead back")


def _entries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What folders hold; a file is its own entry, and what has gone meanwhile has none."""
    for batch in rows:
        for root, path in zip(*(c.to_pylist() for c in batch.columns)):
            fs, own = file_system(path)
            prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
            info = fs.get_file_info(own)
            entries = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(own, allow_not_found=True))
            entries = [x for x in entries if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([root] * len(entries), pa.string()), pa.array([prefix + x.path for x in entries], pa.string()), pa.array([not x.is_file for x in entries], pa.bool_()),
                    pa.array([int(x.mtime.timestamp() * 1_000_000) if x.mtime else 0 for x in entries], pa.timestamp("us", "UTC")), pa.array([x.size if x.is_file else 0 for x in entries], pa.int64()),
                ],
                ["root", "path", "folder", "modificationTime", "length"],
            )


def select_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, hidden: tuple[str, ...] = HIDDEN, dotfiles: bool = False, driver: str = "local") -> DataFrame:
    """Of a listing (path, relative_path, modificationTime, length) the files to show, with name, identifier, readable size and fingerprint."""
    name = F.substring_index("path", "/", -1)
    keep = F.lit(True)
    if extensions:
        keep &= F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin([x.lower() for x in extensions])
    if not dotfiles:
        keep &= ~name.startswith(".")
    for glob in hidden:
        keep &= ~name.rlike(glob_pattern(glob))
    files = files.filter(keep).withColumns({"name": name, "driver": F.lit(driver), "identifier": file_identifier(F.lit(driver), F.col("path"))})
    return files.select("path", "name", "relative_path", "driver", "identifier", F.col("length").alias("size"), size_human(F.col("length")).alias("size_human"), F.col("modificationTime").alias("last_modified"), fingerprint(F.col("length"), F.unix_timestamp("modificationTime")).alias("fingerprint"))


def file_info(files: DataFrame, max_mb: int = 100) -> DataFrame:
    """``files`` with size_human and whether they may be downloaded whole."""
    return files.withColumns({"size_human": size_human(F.col("size")), "downloadable": F.col("size") <= max_mb * MB})


def export_policy(files: DataFrame, mode: str | Column = "full", confirm: bool | Column = False, max_mb: int = 100, ask_mb: int = 25) -> DataFrame:
    """``files`` with ``policy``: tail (any size), blocked, confirm or full."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    confirm = F.lit(confirm) if isinstance(confirm, bool) else confirm
    policy = F.when(mode == "tail", "tail").when(F.col("size") > max_mb * MB, "blocked").when((F.col("size") > ask_mb * MB) & ~confirm, "confirm").otherwise("full")
    return files.withColumn("policy", policy)


def export_tail(lines: DataFrame, n: int = 1000, most: int = 5000) -> DataFrame:
    """The last n physical lines of every file: file, offset, value (without line break, as text sinks add it)."""
    return last_lines(lines, clamp_limit(n, most=most)).select("file", "offset", F.col("raw").alias("value"))


def export_full(lines: DataFrame) -> DataFrame:
    """All physical lines: file, offset, value."""
    return lines.select("file", "offset", F.col("raw").alias("value"))


def write_text(exported: DataFrame, path: str) -> None:
    """Write exported lines as text, a folder for each file, in the order of offsets."""
    exported.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def write_records(records: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Keep records by day for repeated queries; undated ones are under a day of their own. Ranges of (day, file, offset) spread a long day over tasks.

    Rows lie in the order of file and offset, so that a file's and an offset range's rows are in few row groups, whose
    statistics a reader's filters skip by.
    """
    by_day = records.withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("undated")))
    by_day.repartitionByRange("day", "file", "offset").sortWithinPartitions("day", "file", "offset").write.format(format).mode(mode).partitionBy("day").save(path)


def read_records(spark: SparkSession, path: str, criteria: Criteria, format: str = "parquet") -> DataFrame:
    """Kept records of the days that the criteria's bounds touch, and undated ones; other days aren't read. The criteria themselves are still to be applied."""
    rows = spark.read.format(format).load(path)
    day = F.col("day").cast("string")
    low, high = (None if x is None else x.strftime("%Y-%m-%d") for x in criteria.bounds())
    dated = F.lit(True)
    if low is not None:
        dated &= day >= low
    if high is not None:
        dated &= day <= high
    return rows.filter(dated | (day == "undated"))


def to_result_json(records: DataFrame) -> DataFrame:
    """file, offset and ``json``: the record as the API's nested object, absent values as null."""
    head = F.struct("parser", "level", "datetime", "channel", "message", F.try_parse_json("context").alias("context"), "extra")
    return records.select("file", "offset", F.to_json(F.struct("offset", "end_offset", "raw", "truncated", head.alias("parsed")), {"ignoreNullFields": "false"}).alias("json"))
