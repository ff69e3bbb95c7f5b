"""Helpers shared by the corpus operators: shared folders, written cuts of lineage, input tables."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import dropped, shared_path  # noqa: F401


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    return storage.written(df, name, file_rows)


#: Rows that an Arrow batch holds at most: with long texts the default of 10,000 takes hundreds of MB a worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_given_back = 0.0


def give_back(every: float = 1.0) -> None:
    """Returns to the system what this worker's allocators hold and don't use; at most once in `every` seconds."""
    global _given_back
    if time.monotonic() - _given_back < every:
        return
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
    _given_back = time.monotonic()


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, for mapInArrow: Spark keeps Python workers for later stages, so each gives back unused memory when its task ends."""

    def lean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back(0.0)

    return lean_rows


def id_crc(column: str = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of `key` only: the same rows on any cluster and partitioning."""
    n = df.count()
    if n <= bound:
        return df
    cells = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(20)), F.lit(cells)) < int(cells * bound / n))


def bounded_broadcast(small: DataFrame, rows: int, bound: int) -> DataFrame:
    """`small` with a broadcast hint where its counted rows are within the bound; else a shuffled join stays."""
    return F.broadcast(small) if rows <= bound else small
