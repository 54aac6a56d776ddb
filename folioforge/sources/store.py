"""A cache with a budget of bytes.  What it gives never depends on whether it had it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class Store:
    """Least recently used values go first.  budget 0: no limit; a value larger than the budget is never kept; a failure, kept
    as None, costs one byte."""

    def __init__(self, budget: int = 0):
        self.budget, self.used = budget, 0
        self.held: OrderedDict[Hashable, tuple[Any, int]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any], size: Callable[[Any], int] = len) -> Any:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        value = make()
        self.put(key, value, 1 if value is None else size(value))
        return value

    def put(self, key: Hashable, value: Any, size: int) -> None:
        if key in self.held:
            self.used -= self.held.pop(key)[1]
        if self.budget and size > self.budget:
            return
        self.held[key] = value, size
        self.used += size
        while self.budget and self.used > self.budget:
            self.used -= self.held.popitem(last=False)[1][1]

    def clear(self) -> None:
        self.held.clear()
        self.used = 0
