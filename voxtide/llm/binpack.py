"""Best-fit-decreasing over size classes.

Items of one size are interchangeable, so a packing is planned from the histogram (size, count)
and not from the items: the plan's cost follows the number of distinct sizes, whatever the number
of items. Bins that hold the same sizes form a *run* of consecutive bin numbers; open runs live
in a balanced tree ordered by remaining capacity, where the tightest fit is a ceiling search.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field


class _Node:
    __slots__ = ("key", "left", "load", "priority", "right")

    def __init__(self, key: tuple[int, int], load: int, priority: float) -> None:
        self.key, self.load, self.priority = key, load, priority
        self.left: _Node | None = None
        self.right: _Node | None = None


class CapacityTree:
    """A treap (balanced in expectation) of runs: (remaining capacity, first bin) -> number of bins."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self._random = random.Random(7)

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _merge(self, low: _Node | None, high: _Node | None) -> _Node | None:
        if low is None or high is None:
            return low or high
        if low.priority > high.priority:
            low.right = self._merge(low.right, high)
            return low
        high.left = self._merge(low, high.left)
        return high

    def add(self, remaining: int, first: int, bins: int) -> None:
        low, high = self._split(self.root, (remaining, first))
        node = _Node((remaining, first), bins, self._random.random())
        self.root = self._merge(self._merge(low, node), high)

    def pop_tightest(self, size: int) -> tuple[int, int, int] | None:
        """Remove and return (remaining, first, bins) of the run with the least remaining >= size."""
        node, best = self.root, None
        while node is not None:
            if node.key[0] >= size:
                best, node = node, node.left
            else:
                node = node.right
        if best is None:
            return None
        low, high = self._split(self.root, best.key)
        _, high = self._split(high, (best.key[0], best.key[1] + 1))
        self.root = self._merge(low, high)
        return *best.key, best.load


@dataclass
class Plan:
    """Ranges of a size's ranks: rank in [lo, hi) goes to bin ``first + (rank - lo) // each``,
    at ``base + (rank - lo) % each * size``."""

    bins: int = 0
    size: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)

    def put(self, size: int, lo: int, n: int, first: int, each: int, base: int) -> int:
        """Add a range of n items; return the rank after it."""
        if n:
            for column, value in zip((self.size, self.lo, self.hi, self.first, self.each, self.base), (size, lo, lo + n, first, each, base), strict=True):
                column.append(value)
        return lo + n

    def columns(self) -> dict[str, list[int]]:
        return {"p_size": self.size, "p_lo": self.lo, "p_hi": self.hi, "p_first": self.first, "p_each": self.each, "p_base": self.base}


PLAN_SCHEMA = "p_size long, p_lo long, p_hi long, p_first long, p_each long, p_base long"


def best_fit_decreasing(classes: dict[int, int], capacity: int, plan: Plan | None = None, used: dict[int, int] | None = None, max_bins: int | None = None) -> Plan | None:
    """Pack ``classes`` (size -> count), largest size first, each item in the tightest open bin.

    ``plan`` and ``used`` (ranks already taken of a size) carry bins that are fixed beforehand.
    None if ``max_bins`` do not suffice. Every size must be in 1..capacity.
    """
    plan, used, tree = plan or Plan(), used or {}, CapacityTree()
    for size in sorted(classes, reverse=True):
        rank, left = used.get(size, 0), classes[size]
        while left:
            run = tree.pop_tightest(size)
            if run is None:
                each = capacity // size
                bins = -(-left // each)
                if max_bins is not None and plan.bins + bins > max_bins:
                    bins = max_bins - plan.bins
                    if bins <= 0 or bins * each < left:
                        return None
                run = (capacity, plan.bins, bins)
                plan.bins += bins
            room, first, bins = run
            each = room // size
            full = min(bins, left // each)
            rank = plan.put(size, rank, full * each, first, each, capacity - room)
            left -= full * each
            if full:
                tree.add(room - each * size, first, full)
            if full < bins:
                if left:  # fewer than fill one more bin
                    rank = plan.put(size, rank, left, first + full, left, capacity - room)
                    tree.add(room - left * size, first + full, 1)
                    left, full = 0, full + 1
                if full < bins:
                    tree.add(room, first + full, bins - full)
    return plan
