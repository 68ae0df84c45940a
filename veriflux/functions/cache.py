"""A least-recently-used cache, and which accesses of a log would have hit one."""

from __future__ import annotations

from collections import OrderedDict


class LruCache:
    """Holds ``capacity`` values, none if that is 0; a read makes its key the most recent."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.hits, self.reads = capacity, OrderedDict(), 0, 0

    def get(self, key):
        self.reads += 1
        if key not in self.held:
            return None
        self.hits += 1
        self.held.move_to_end(key)
        return self.held[key]

    def put(self, key, value) -> None:
        if self.capacity <= 0:
            return
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)

    def hit_rate(self) -> float:
        return self.hits / self.reads if self.reads else 0.0
