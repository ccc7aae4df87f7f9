"""Run-length index of a text: run-compressed Burrows-Wheeler transform with sampled run ends.

``longest_elsewhere`` streams matching statistics of the text against itself: for every
position, the longest string starting there that also starts somewhere else. In suffix
order that is the longer common prefix with a neighbour. The prefix shared with the suffix
before (after) shrinks by one from a text position to the next unless the position stands at
the head (end) of a run of the transform, so it is computed at the sampled run heads and
ends alone and carried along the text: work and samples follow the number of runs, which
stays small in repetitive text.

The suffix order comes from prefix doubling, whose ranks also give the common prefixes.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Index of ``text`` (uint8) in which no string of ``depth`` (a power of two times 8) or more occurs twice."""

    def __init__(self, text: np.ndarray, depth: int = 1024):
        n = len(text)
        padded = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n]
        self.levels: list[tuple[int, np.ndarray]] = []
        size = 8
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n + depth, np.int64)
            rank[n:] = 0
            rank[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))[:n]
            self.levels.append((size, rank.astype(np.int32)))
            if size >= depth or rank[:n].max(initial=0) == n:
                break
            key = rank[:n] * (n + 1) + rank[size : size + n]
            size *= 2
        self.text, self.order = text, order
        self.transform = text[order - 1].astype(np.int16)  # the character before each suffix, in suffix order
        self.transform[order == 0] = -1  # nothing stands before the whole text
        change = np.flatnonzero(self.transform[1:] != self.transform[:-1]) + 1
        self.heads = np.concatenate(([0], change))
        self.ends = np.concatenate((change - 1, [n - 1]))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(character, length) of each run of the transform."""
        return self.transform[self.heads], self.ends - self.heads + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a[i] and b[i]."""
        n = len(self.text)
        length = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            x, y = np.minimum(a + length, n), np.minimum(b + length, n)
            length += np.where((x < n) & (y < n) & (rank[x] == rank[y]), size, 0)
        padded = np.append(self.text, 0)
        open_ = np.ones(len(a), bool)
        for _ in range(8):
            x, y = np.minimum(a + length, n), np.minimum(b + length, n)
            open_ &= (x < n) & (y < n) & (padded[x] == padded[y])
            length += open_
        return length

    def longest_elsewhere(self) -> np.ndarray:
        n = len(self.text)
        best = np.zeros(n, np.int64)
        place = np.arange(n)
        for sample, neighbour in ((self.heads, -1), (self.ends, 1)):
            other = sample + neighbour
            inside = (other >= 0) & (other < n)
            value = np.zeros(len(sample), np.int64)
            value[inside] = self.common(self.order[sample[inside]], self.order[other[inside]])
            at = self.order[sample]
            first = np.argsort(at)
            at, value = at[first], value[first]
            last = np.searchsorted(at, place, side="right") - 1
            carried = np.where(last >= 0, value[last] - (place - at[last]), 0)
            np.maximum(best, carried, out=best)
        return best
