"""Memory of Python workers, which outlive a stage."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system at a task's end, so that a later stage's JVM can have it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
