"""The span record and an ordered set of claimed intervals."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple


class Span(NamedTuple):
    """A typed stretch [start, end) of code points."""

    start: int
    end: int
    category: str
    text: str
    score: float
    source: str  # rules, field or neural
    detector: str
    structured: bool = False


class Claims:
    """Intervals that don't overlap, in order; all questions take logarithmic time."""

    def __init__(self, spans=()):
        self._edges: list[tuple[int, int]] = sorted((s.start, s.end) for s in spans)

    def add(self, start: int, end: int) -> None:
        insort(self._edges, (start, end))

    def within(self, start: int, end: int) -> list[tuple[int, int]]:
        """The claimed intervals that overlap [start, end)."""
        first = max(0, bisect_right(self._edges, (start, start)) - 1)
        out = []
        for k in range(first, len(self._edges)):
            a, b = self._edges[k]
            if a >= end:
                break
            if b > start:
                out.append((a, b))
        return out

    def free(self, start: int, end: int) -> bool:
        return not self.within(start, end)


def inside(position: int, starts: list[int], segments: list[tuple[int, int, str]]) -> bool:
    """Whether any segment holds the position. segments are sorted by start, starts are their starts."""
    return any(position < e for _, e, _ in segments[: bisect_left(starts, position + 1)])
