"""Helpers of the text operators: reading texts in tasks, and hashing in SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkeep.common import remove, shared_dir

# Whether the shuffle files of a query go as soon as it has ended. Without that they stay until the driver collects its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of text that a task unpacks at a time. Words and n-grams of a slice take some 25 times its size.
SLICE_BYTES = 1 << 20


def sliced(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column as bytes (null: empty), about a megabyte at a time, with the first row's number.

    A single longer text is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(column)
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, [x or b"" for x in column.slice(start, stop - start).to_pylist()]
        start = stop


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from one task to the next: a loaded model, a bounded memory of words."""
    holder = sys.modules.setdefault("mirrorkeep_worker_memory", ModuleType("mirrorkeep_worker_memory"))
    if name not in vars(holder):
        setattr(holder, name, make())
    return vars(holder)[name]


def read_all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None


def tasks(df: DataFrame) -> int:
    """Tasks that hold their rows in Python: never fewer than the session's number, which its user sets by memory."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Staged tables of one job that go before it ends, and with each of them the shuffles it was made by."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table to a fresh shared folder and read it back; its shuffle files go at once."""
        path, before = shared_dir(self.spark, name), self.spark.conf.get(FILES_GO)
        self.paths.setdefault(name, []).append(path)
        self.spark.conf.set(FILES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FILES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, which nothing may read any more, and what the driver holds of ended queries.

        The driver's heap would else grow to its limit before it is collected, however little of it is in use.
        """
        for path in (p for name in names for p in self.paths.pop(name, [])):
            remove(self.spark, path)
        self.spark._jvm.System.gc()


def md5_bits(col: Column, bits: int) -> Column:
    """The first bits (a multiple of 4, at most 60) of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, bits // 4), 16, 10).cast("bigint")
