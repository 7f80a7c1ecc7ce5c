"""Helpers of the text operators: Arrow columns as flat bytes, keys of rows, casts of names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What operators keep in a worker between partitions, by operator, and how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, release: Callable[[], None]) -> None:
    _KEPT[operator] = release


def release_others(operator: str) -> None:
    """Let go of what other operators keep in this worker; Spark uses workers again for later jobs."""
    others = [release for name, release in _KEPT.items() if name != operator]
    for release in others:
        release()
    if others:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: freed memory is used again, only not handed back
            pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about so many bytes of text each, a longer row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(name))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def text_key(column: Column) -> Column:
    """With the id it tells rows apart; null and empty texts share one key."""
    return F.coalesce(F.md5(column), F.lit(""))


def records(batch_like: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_like[f.name], f.type) for f in schema], schema=schema)
