"""Ordered helpers of the assignment pass: used ranges, and searches over numbered lines. Plain numbers, no Spark."""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np

NONE = -(1 << 62)


class Ranges:
    """A growing set of ranges [start, end), kept as disjoint ones in order.

    ``hits(a, b)`` says whether any range added satisfies ``start < b and end > a``; ranges that only touch stay apart, so that
    this holds for empty ranges and empty questions too.
    """

    def __init__(self) -> None:
        self.starts, self.ends = array("q"), array("q")

    def hits(self, a: int, b: int) -> bool:
        last = bisect_left(self.starts, b) - 1
        return last >= 0 and self.ends[last] > a

    def add(self, start: int, end: int) -> None:
        stop = bisect_left(self.starts, end)
        first = stop
        while first and self.ends[first - 1] > start:
            first -= 1
        if first < stop:
            if start == end:
                return
            start, end = min(start, self.starts[first]), max(end, self.ends[stop - 1])
        elif start == end:
            while stop < len(self.starts) and self.starts[stop] == start and self.ends[stop] == end:
                return
            first = stop
        self.starts[first:stop] = array("q", [start])
        self.ends[first:stop] = array("q", [end])


class Tree:
    """Greatest value of two columns over each aligned span of rows, for searches that leave out what cannot match."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        """``low`` is searched for values below a limit, ``high`` for values above one."""
        self.size = 1 << max(0, (len(low) - 1)).bit_length()
        least = np.full(2 * self.size, -NONE, np.int64)
        most = np.full(2 * self.size, NONE, np.int64)
        least[self.size : self.size + len(low)], most[self.size : self.size + len(high)] = low, high
        at = self.size
        while at > 1:
            half = at // 2
            least[half:at] = np.minimum(least[at : 2 * at : 2], least[at + 1 : 2 * at : 2])
            most[half:at] = np.maximum(most[at : 2 * at : 2], most[at + 1 : 2 * at : 2])
            at = half
        self.least, self.most = array("q", least.tobytes()), array("q", most.tobytes())

    def exists(self, first: int, stop: int, below: int, above: int) -> bool:
        """Whether a row of [first, stop) has low < ``below`` and high > ``above``."""
        least, most = self.least, self.most
        todo = []
        left, right = first + self.size, stop + self.size
        while left < right:
            if left & 1:
                todo.append(left)
                left += 1
            if right & 1:
                right -= 1
                todo.append(right)
            left, right = left >> 1, right >> 1
        while todo:
            node = todo.pop()
            if least[node] < below and most[node] > above:
                if node >= self.size:
                    return True
                todo += (2 * node, 2 * node + 1)
        return False

    def drop(self, row: int) -> None:
        """Take a row out of all later searches."""
        least, most, node = self.least, self.most, row + self.size
        least[node], most[node] = -NONE, NONE
        while node > 1:
            node >>= 1
            least[node], most[node] = min(least[2 * node], least[2 * node + 1]), max(most[2 * node], most[2 * node + 1])
