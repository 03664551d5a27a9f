"""Helpers shared by the operators: column choice, Arrow slices, sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import session

SLICE_BYTES = 4_000_000
"""Text handled at once inside a Python worker; one longer text is a slice of its own."""


BATCH_ROWS = 1000
"""Rows of an Arrow batch: whole texts travel in them, so Spark's 10,000 would take tens of megabytes on either side of a worker."""
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, and batches that fit whole texts unless the session chose a size."""
    session.ship_package(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text under fixed names and nothing else; a null text is empty."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose ``column`` holds about ``limit`` bytes each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that Spark uses again for other stages would keep all it ever held."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    """The C library's trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None
