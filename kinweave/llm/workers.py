"""What a Python worker keeps between tasks.

A worker waits for its next task beside a JVM whose heap is mostly in use, so freed memory that its allocators hold
counts against the executor as if it were used.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Free memory that this process holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, with ``give_back`` when they end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
