"""T-occurrence search by DivideSkip: which indexed sets share at least T tokens with a query?"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import merge
from itertools import groupby


class DivideSkip:
    """Inverted lists over small whole-number set ids, added in rising order."""

    def __init__(self, mu: float = 0.05):
        self.mu, self.lists = mu, {}

    def add(self, set_id: int, tokens) -> None:
        for t in tokens:
            found = self.lists.get(t)
            if found is None:
                self.lists[t] = [set_id]
            else:
                found.append(set_id)

    def search(self, tokens, least: int) -> list[tuple[int, int]]:
        """(set id, shared tokens) of every set that shares at least `least` >= 1 tokens.

        The L longest lists are set apart. A set must stand at least least - L times in the others, which are merged by a heap;
        what does is then looked up in the long lists by binary search."""
        get = self.lists.get
        lists = [x for t in tokens if (x := get(t)) is not None]
        if len(lists) < least:
            return []
        lists.sort(key=len)
        apart = min(least - 1, int(least / (self.mu * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
        out = []
        for s, run in groupby(short[0] if len(short) == 1 else merge(*short)):
            n = sum(1 for _ in run)
            if n < least - apart:
                continue
            for k, x in enumerate(long):
                if n + len(long) - k < least:
                    break
                p = bisect_left(x, s)
                n += p < len(x) and x[p] == s
            if n >= least:
                out.append((s, n))
        return out
