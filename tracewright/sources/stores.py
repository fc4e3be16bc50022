"""File systems by address, and the folder for tables that a job writes on its way."""

from __future__ import annotations

import fnmatch
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Tables of so many rows are held by the driver rather than written.
HELD_ROWS = 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, run once and read from a Parquet table in the shared folder, so that its uses and lost executors don't run it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str, most: int = HELD_ROWS) -> DataFrame:
    """``df``, run once: up to ``most`` rows pass through the driver and are a local table, more are ``written``. For rows of a few numbers alone."""
    few = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(few, df.schema) if few.num_rows <= most else written(df, name)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; an address without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def sizes(path: str, recursive: bool = False, hidden: bool = True) -> dict[str, tuple[int, float]]:
    """Size and modification time (in seconds) of a file, of the files of a folder, or of those that a glob in the last part names; only the listing is read.

    Without ``hidden`` names that begin with a dot or an underscore are left out, as in Spark's own listing.
    """
    fs, own = file_system(path)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    head, _, last = own.rpartition("/")
    if any(c in last for c in "*?["):
        found = fs.get_file_info(pafs.FileSelector(head or "/", allow_not_found=True))
        found = [x for x in found if fnmatch.fnmatchcase(x.base_name, last)]
    else:
        info = fs.get_file_info(own)
        found = fs.get_file_info(pafs.FileSelector(own, recursive=recursive)) if info.type == pafs.FileType.Directory else [info]
    return {prefix + x.path: (x.size, x.mtime.timestamp() if x.mtime else 0.0) for x in sorted(found, key=lambda x: x.path) if x.is_file and (hidden or x.base_name[:1] not in "._")}
