"""Static binary fuse filters: sets of 64-bit keys in about 18 bits a key.

A key has one place in each of three consecutive segments; its fingerprint is the XOR
of the three. Built by peeling: keys that are alone in a place are taken out, round by
round, and filled in backwards. Whole rounds are array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vidmatch.llm.arrays import mixed


@dataclass
class Filter:
    seed: int
    segment: int
    segments: int
    cells: np.ndarray  # uint16

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about one in 65,536 others."""
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        at, prints = _places(keys, self.seed, self.segment, self.segments)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == prints


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.astype(np.uint64) + mixed(np.array([seed], np.uint64)))
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    prints = (mixed(h) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.stack([first, second, third]).astype(np.int64), prints


def build(keys: np.ndarray) -> Filter:
    """The filter of a set of keys (repeats are fine)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return Filter(0, 1, 0, np.zeros(0, np.uint16))
    # Segment length and size factor that make peeling succeed.
    segment = 1 << min(18, max(2, int(np.log(n) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    seed = 0
    while True:
        seed += 1
        if seed % 10 == 0:
            segments += 1 + segments // 8
        at, prints = _places(keys, seed, segment, segments)
        size = segment * (segments + 2)
        rounds = _peel(at, size)
        if rounds is not None:
            break
    cells = np.zeros(size, np.uint16)
    for own, cell in reversed(rounds):
        cells[cell] = prints[own] ^ cells[at[0, own]] ^ cells[at[1, own]] ^ cells[at[2, own]]
    return Filter(seed, segment, segments, cells)


def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the place of each that no other key has); None if some keys remain."""
    n = at.shape[1]
    left = np.arange(n)
    count = np.bincount(at.ravel(), minlength=size)
    who = np.bincount(at.ravel(), np.tile(left, 3), size)  # sum of the keys in a place
    rounds, done = [], 0
    cells = np.flatnonzero(count == 1)
    while len(cells):
        own, pick = np.unique(who[cells].astype(np.int64), return_index=True)
        rounds.append((own, cells[pick]))
        done += len(own)
        places = at[:, own].ravel()
        np.subtract.at(count, places, 1)
        np.subtract.at(who, places, np.tile(own, 3))
        cells = np.unique(places)
        cells = cells[count[cells] == 1]
    return rounds if done == n else None
