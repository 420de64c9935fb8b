"""Small helpers for functions that run over Arrow batches."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step takes at a time; bounds the memory of a task.
SLICE_BYTES = 1 << 20


@functools.cache
def _trim():
    """The C library's function that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)


def release_memory() -> None:
    """Give back what earlier tasks of this worker process have freed; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column`, or one row if that is longer."""
    release_memory()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, size in enumerate(sizes):
            if k > start and total + size > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    release_memory()
