"""Mergeable Misra-Gries summaries of 64-bit hashes.

A summary has room for ``capacity`` counters. Where more are needed, the count of the first one
without room is taken from all, and what is left of none goes; ``lost`` adds up what was taken. A
hash's true count lies between its counter (0 without one) and that plus ``lost``, after any
sequence of merges. ``lost`` never exceeds the mass over ``capacity + 1``, so with a capacity above
mass / threshold no hash that occurs ``threshold`` times can be missing.
"""

import numpy as np

_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def tally(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts (1 each where none are given)."""
    if counts is None:
        return np.unique(hashes, return_counts=True)
    if not len(hashes):
        return _NONE
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts[order], first)


class Summary:
    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = _NONE

    def add(self, hashes: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Merge another summary of the same capacity: its counters and what it has lost."""
        hashes, counts = tally(np.concatenate([self.hashes, hashes]), np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(hashes) > self.capacity:
            taken = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > taken
            hashes, counts = hashes[left], counts[left] - taken
            self.lost += taken
        self.hashes, self.counts = hashes, counts

    def possible(self, threshold: int) -> np.ndarray:
        """Every hash with a counter that may have occurred ``threshold`` times."""
        return self.hashes[self.counts + self.lost >= threshold]
