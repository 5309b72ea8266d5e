"""Ratcliff-Obershelp similarity, as difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() gives it, by substring searches.

difflib takes the longest common block of two texts (of several the first in a, then the first in b), and goes on left and right of
it. So does this. A block is found by looking for ever longer pieces of a in b, at those places only whose first characters are
somewhere in b; of a large pair of ranges, by ranks of pieces. When no blocks can lift the ratio over what is asked for, it stops.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter

import numpy as np

#: Cells of a pair of ranges from which ranks are faster than searches, and the length of the pieces by which places are chosen. No result depends on them.
LARGE, PIECE = 1 << 18, 4


class Ranks:
    """Numbers for pieces of two texts of 1, 2, 4, ... characters: equal pieces, equal numbers."""

    def __init__(self, a: str, b: str):
        codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.behind, self.by_power = len(a), [np.unique(codes, return_inverse=True)[1].astype(np.int64)]

    def pieces(self, at: int, end: int, size: int) -> np.ndarray:
        power = size.bit_length() - 1
        while len(self.by_power) <= power:
            last, half = self.by_power[-1], 1 << len(self.by_power) - 1
            joined = np.zeros_like(last)  # pieces that reach over the end are never asked for
            if len(last) > half:
                joined[:-half] = np.unique(last[:-half] * len(last) + last[half:], return_inverse=True)[1]
            self.by_power.append(joined)
        r, back = self.by_power[power], size - (1 << power)
        return r[at : end - size + 1] * len(r) + r[at + back : end - size + back + 1]

    def first(self, box: tuple[int, int, int, int], size: int) -> int:
        """Where in a's range the first piece of so many characters begins that is in b's range, or -1."""
        found = np.isin(self.pieces(box[0], box[1], size), self.pieces(self.behind + box[2], self.behind + box[3], size))
        i = int(found.argmax())
        return box[0] + i if found[i] else -1

    def longest(self, a: str, b: str, box: tuple[int, int, int, int], most: int) -> tuple[int, int, int]:
        low, high, x, grows = 0, min(most, box[1] - box[0], box[3] - box[2]), 0, True
        while low < high:
            size = min(high, 2 * low + 4) if grows else (low + high + 1) // 2
            if (i := self.first(box, size)) < 0:
                high, grows = size - 1, False
            else:
                low, x = size, i
        return x, b.find(a[x : x + low], box[2], box[3]), low


def longest(a: str, b: str, box: tuple[int, int, int, int], places, size: int) -> tuple[int, int, int]:
    """The longest common block (where in a, where in b, how long) of over `size` characters that begins at one of the places; else of none."""
    _, end, low, high = box
    x = y = least = 0
    for i in places:
        while i + size < end and (j := b.find(a[i : i + size + 1], low, high)) >= 0:
            size += 1
            while i + size < end and j + size < high and a[i + size] == b[j + size]:
                size += 1
            x, y, least = i, j, size
    return x, y, least


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """The ratio, 0 if either text is empty; `least` if it is not over that."""
    if not a or not b:
        return max(least, 0.0)
    if a == b:
        return max(least, 1.0)
    whole, matched, open_ = len(a) + len(b), 0, min(len(a), len(b))
    if 2 * open_ / whole <= least or 2 * (Counter(a) & Counter(b)).total() / whole <= least:
        return least
    ranks = places = None
    boxes = [(-open_, open_, (0, len(a), 0, len(b)))]  # the largest first
    while boxes:
        less, most, box = heapq.heappop(boxes)
        at, end, low, high = box
        if (end - at) * (high - low) > LARGE:
            ranks = ranks or Ranks(a, b)
            x, y, size = ranks.longest(a, b, box, most)
        else:
            if places is None:
                there = {b[j : j + PIECE] for j in range(len(b) - PIECE + 1)}
                places = [i for i in range(len(a) - PIECE + 1) if a[i : i + PIECE] in there]
            x, y, size = longest(a, b, box, places[bisect_left(places, at) : bisect_left(places, end)], PIECE - 1)
            if not size:
                x, y, size = longest(a, b, box, range(at, end), 0)
        open_ += less
        if size:
            matched += size
            for side in ((at, x, low, y), (x + size, end, y + size, high)):
                if (n := min(side[1] - side[0], side[3] - side[2])) > 0:
                    open_ += n
                    heapq.heappush(boxes, (-n, size, side))
        if 2 * (matched + open_) / whole <= least:
            return least
    return max(least, 2 * matched / whole)


def neighbour_similarity(blocks: list[str]) -> float:
    """The largest similarity of two blocks in a row. Pairs of like lengths come first; of the others it is often told at once that they are less alike."""
    out = 0.0
    for a, b in sorted(zip(blocks, blocks[1:]), key=lambda p: -min(map(len, p)) / max(1, len(p[0]) + len(p[1]))):
        out = similarity(a, b, out)
    return out
