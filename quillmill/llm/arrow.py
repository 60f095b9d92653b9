"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_CHARS = 2_000_000


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` makes batches of a batch; state lives in the function's module."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
            del batch  # before the next one is read
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that is free in this worker to the machine. Workers live on from stage to stage,
    and what their allocators keep would add up with what the next stage needs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if trim is not None:
            trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over a partition that gives memory back at its end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def runs_by_size(sizes: list[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` together, at least one item each."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of every range, one after another."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    shift = np.repeat(starts.astype(np.int64) - (ends - counts), counts)
    return shift + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
