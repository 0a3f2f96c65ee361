"""What a Python worker keeps between its tasks: objects of one operator at a time, in caches bounded by bytes."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Bytes that all entries of a cache take, about.
CACHE_BYTES = 24 << 20
#: Bytes of an entry beside its key's and value's own characters: two objects and a place in a dictionary.
ENTRY_BYTES = 200


def holder() -> types.ModuleType:
    return sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))


def begin(owner: str) -> None:
    """Called at the start of a task: what an earlier operator kept in this worker is forgotten, and free memory is given back to the system."""
    here = holder()
    if getattr(here, "owner", owner) != owner:
        vars(here).clear()
    here.owner = owner
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of this name in this worker process, made at its first use.  Functions are unpickled anew for each task, so their own globals don't last."""
    here = vars(holder())
    if name not in here:
        here[name] = make()
    return here[name]


class Cache(dict):
    """A function's results by argument (a text).  When they take half of CACHE_BYTES, those not asked for since the last such time are forgotten."""

    def __init__(self, function: Callable[[str], Any], most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.function, self.most, self.older, self.size = function, most, {}, 0

    def __missing__(self, key: str) -> Any:
        found = self.older.pop(key, self)
        if found is self:
            found = self.function(key)
        if self.size >= self.most // 2:
            self.older = dict(self)
            self.clear()
            self.size = 0
        self[key] = found
        self.size += ENTRY_BYTES + len(key) + (len(found) if hasattr(found, "__len__") else 0)
        return found
