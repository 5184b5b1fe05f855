"""LRU cache with an optional age limit, for the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class LruCache:
    def __init__(self, size: int = 100, ttl_s: float | None = None, clock: Callable[[], float] = time.monotonic):
        if size < 1:
            raise ValueError("size must be at least 1")
        self.size, self.ttl, self.clock = size, ttl_s, clock
        self._d: OrderedDict[Hashable, tuple[Any, float]] = OrderedDict()
        self.hits = self.misses = 0

    def _live(self, key) -> bool:
        if key not in self._d:
            return False
        if self.ttl is not None and self.clock() - self._d[key][1] > self.ttl:
            del self._d[key]
            return False
        return True

    def get(self, key, default=None):
        if not self._live(key):
            self.misses += 1
            return default
        self.hits += 1
        self._d.move_to_end(key)
        return self._d[key][0]

    def set(self, key, value) -> None:
        self._d[key] = (value, self.clock())
        self._d.move_to_end(key)
        while len(self._d) > self.size:
            self._d.popitem(last=False)

    def has(self, key) -> bool:
        return self._live(key)

    def delete(self, key) -> bool:
        return self._d.pop(key, None) is not None

    def clear(self) -> None:
        self._d.clear()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self._d)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self._d), "capacity": self.size, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
