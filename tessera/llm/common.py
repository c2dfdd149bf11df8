"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.storage import discard, stored

__all__ = ["by_size", "crc_mod", "discard", "map_rows", "release", "with_columns", "sampled", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the column's text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def sampled(key: Column, share: Column | float, seed: int) -> Column:
    """True for about this share of the keys, chosen by hash, the same ones on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


#: What a worker keeps from one task for the next ones, by the number of the call that these belong to.
LIVE: dict[str, object] = {}


def live(call: str, build: Callable[[], object]) -> object:
    """What the worker's last task of the call left, or else a new one."""
    only(call)
    if call not in LIVE:
        LIVE[call] = build()
    return LIVE[call]


def only(call: str | None) -> None:
    """Drop what other calls left in this worker."""
    for other in [k for k in LIVE if k != call]:
        del LIVE[other]


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], step: int = 512, call: str | None = None) -> DataFrame:
    """Apply make()'s function to slices of at most `step` rows of each Arrow batch; make runs once per task. A worker gives back
    its memory after each task, besides what is live for the same call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(call)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield work(batch.slice(start, step))
        work = batch = None
        release()

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], step: int = 512, call: str | None = None) -> DataFrame:
    """df and new columns; a column of df that has the name of a new one is replaced."""
    added = StructType.fromDDL(fields)
    names = [c for c in df.columns if c not in added.fieldNames()]
    schema = StructType([*df.select(*names).schema, *added])

    def whole():
        work = make()
        return lambda batch: pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *work(batch)], schema.fieldNames())

    return map_rows(df, schema, whole, step, call)


def by_size(texts: list[str], limit: int = 1_000_000, most: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` neighbouring texts that hold at most `limit` characters, or one longer text."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and (size + len(text) > limit or k - start == most):
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Give freed memory back to the system, as a task's last step: Python workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)
