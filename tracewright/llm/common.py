"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: A batch handed to Python holds at most so many rows and so many bytes.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return given or known.get()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared folder, so that lost executors cost nothing and later steps don't run it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """As ``cut``, for larger data: a Parquet table in the shared folder, compressed and read by column, with a folder for each value of ``by``."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely_sample(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """Of ``n`` rows, those whose hash of ``key`` is in a share that holds about ``4 k`` of them; all rows where that gives fewer than ``k``.

    Ordering what is left by the hash and taking ``k`` gives the same rows as ordering all, but tasks don't each send
    ``k`` rows: what they send in all stays near ``4 k``, however many tasks there are.
    """
    if n <= 4 * k:
        return df
    near = df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int((1 << 31) * 4 * k / n))
    return near if near.select(key).count() >= k else df


def fitting(sizes: list[int], most: int) -> list[int]:
    """The places of those sizes that, taken one by one, fit into what the ones before left of ``most``; one that doesn't fit is skipped."""
    out = []
    for i, size in enumerate(sizes):
        if size <= most:
            most -= size
            out.append(i)
    return out


def by_hash(key: str) -> list:
    """The order that samples are taken in."""
    return [F.pmod(F.xxhash64(key), F.lit(1 << 31)), F.col(key)]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Free memory of the process goes back to the system, where its C library can do that; a worker waits for its next task with what it needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU library
        pass


def batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, for texts may be long; a task gives its free memory back when it ends.

    The bounds are the session's: they hold whenever the plan runs, which is after this call.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(rows)
        give_back()

    return df.mapInArrow(run, schema)


def runs(rows: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Consecutive rows with equal keys from batches sorted by them, as (key, part of the rows, whether a new key begins).

    A group that spans several batches comes in several parts, so a group of any size passes in bounded memory.
    """
    last: tuple | None = None
    for batch in rows:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        found = list(zip(*columns))
        start = 0
        for i in range(1, len(found) + 1):
            if i == len(found) or found[i] != found[start]:
                yield found[start], batch.slice(start, i - start), found[start] != last
                last = found[start]
                start = i
