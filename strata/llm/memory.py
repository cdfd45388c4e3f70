"""Memory of Python workers, which Spark uses again for the next stage."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return what has been freed to the system; else what one stage held at its most stays with its workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
