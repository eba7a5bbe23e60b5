"""What a Python worker keeps from task to task: things of one kind of work at a time.

Workers outlive tasks and stages.  Tables and caches that one stage left in them would stand beside the memory of the next
ones, in Python and in the JVM.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_kept: dict[str, dict] = {}


def kept(work: str) -> dict:
    """What earlier tasks of this kind of work have kept in this worker, to be looked up and added to.  What other work has
    kept is dropped and its memory given back."""
    if _kept and work not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):  # else small blocks stay with the worker
            libc.malloc_trim(0)
    return _kept.setdefault(work, {})
