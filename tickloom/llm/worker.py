"""What a Python worker holds between tasks: one operator's cache at a time, of bounded bytes.

Spark reuses workers, so what an operator remembers would otherwise stand beside what every later one does.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Blocks of this size and more go back to the system when they are freed, instead of staying in the worker's heap.
_OWN_MAPPING = 1 << 20
_held: tuple | None = None
_lean = False


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if c := _libc():
        c.malloc_trim(0)


def cache(owner: str, key: object, make: Callable[[], object]) -> object:
    """The owner's cache under this key; whatever another owner or key has left is dropped first."""
    global _held
    if _held is None or _held[0] != (owner, key):
        _held = None
        gc.collect()
        give_back()
        _held = ((owner, key), make())
    return _held[1]


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, with Arrow's memory taken from the system and given back when a task ends."""

    def held(*args):
        global _lean
        if not _lean:
            _lean = True
            pa.set_memory_pool(pa.system_memory_pool())
            if c := _libc():
                c.mallopt(-3, _OWN_MAPPING)
        try:
            yield from run(*args)
        finally:
            give_back()

    return held


class Remembered(dict):
    """A mapping that empties itself before its entries take more than so many bytes."""

    #: Of an entry: its place in the table, and the headers of key and value.
    ENTRY = 170

    def __init__(self, most: int):
        super().__init__()
        self.most, self.taken = most, 0

    def put(self, key, value, size: int) -> None:
        self.taken += size + self.ENTRY
        if self.taken > self.most:
            self.clear()
            self.taken = size + self.ENTRY
        self[key] = value
