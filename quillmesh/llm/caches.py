"""Memory of worker processes: what an operator remembers there goes at the end of a task, and idle workers stay small."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

_CACHES: list = []


def in_use(cache):
    """Note ``cache`` as one to clear at the end of a task, and return it."""
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    return cache


def release() -> None:
    """Clear the caches of this process and give freed memory back to the system."""
    for c in _CACHES:
        c.clear()
    give_back()


_GROUPS = 0


def after_group() -> None:
    """Give freed memory back to the system after every eighth group of a task, as it is soon taken again."""
    global _GROUPS
    _GROUPS += 1
    if _GROUPS % 8 == 0:
        give_back()


def give_back() -> None:
    """Give freed memory back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that calls ``release`` when it has done the last one."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run
