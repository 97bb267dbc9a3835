"""Greedy string tiling: how much of two word sequences is covered by common runs, whatever their order."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np

_BASE = 0x9E3779B97F4A7C15


def _prefix_hashes(ids: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """h[i] = hash of the first i words; the hash of words i .. i+n is h[i+n] - h[i] * base^n, modulo 2^64."""
    # sums of id * base^-i would need an inverse; base is odd, so it has one
    inverse = pow(_BASE, -1, 1 << 64)
    back = np.cumprod(np.full(len(ids), inverse, np.uint64)) if len(ids) else np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * back)])
    return sums * powers[: len(sums)]


class _Side:
    def __init__(self, ids: np.ndarray, powers: np.ndarray):
        self.hash, self.powers = _prefix_hashes(ids, powers), powers
        self.used = np.zeros(len(ids), bool)
        self.before = np.zeros(len(ids) + 1, np.int64)  # used words before each place

    def count(self) -> None:
        np.cumsum(self.used, out=self.before[1:])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of n words of which none is used."""
        at = np.flatnonzero(self.before[n:] == self.before[:-n]) if n < len(self.before) else np.zeros(0, np.int64)
        return at, self.hash[at + n] - self.hash[at] * self.powers[n]


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of non-overlapping common runs of at least `least` words: always the longest run of
    words not yet covered, among equals the first in a, then the first in b.

    The longest length is found by bisection over hashes of all free runs of one length, then all tiles of that length are
    taken in one walk; what a tile leaves of a longer run is found again at its own length. Tiles of k different lengths
    have at least k (k + 1) / 2 words, so a text of n words has fewer than sqrt(2 n) lengths, each of O(n log n) steps,
    however often words repeat. Hashes only propose: words are compared before a tile is taken.
    """
    if min(len(a), len(b)) < least:
        return []
    known: dict[str, int] = {}
    numbers = [np.array([known.setdefault(w, len(known)) for w in x], np.int64) for x in (a, b)]
    with np.errstate(over="ignore"):
        random = np.random.default_rng(7).integers(1, 1 << 63, len(known), np.uint64)
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(len(a), len(b)), _BASE, np.uint64))])
        one, two = (_Side(random[x], powers) for x in numbers)
        out, high = [], min(len(a), len(b))
        while high >= least:
            one.count(), two.count()
            low, middle = least - 1, high  # a text that lies in the other as a whole is met at once
            while low < high:
                if set(one.windows(middle)[1].tolist()).isdisjoint(two.windows(middle)[1].tolist()):
                    high = middle - 1
                else:
                    low = middle
                middle = (low + high + 1) // 2
            if high < least:
                break
            places: dict[int, deque[int]] = defaultdict(deque)
            for j, h in zip(*(x.tolist() for x in two.windows(high))):
                places[h].append(j)
            free = 0
            for i, h in zip(*(x.tolist() for x in one.windows(high))):
                if i < free or h not in places:
                    continue
                queue = places[h]
                while queue and two.used[queue[0] : queue[0] + high].any():
                    queue.popleft()
                if queue and (numbers[0][i : i + high] == numbers[1][queue[0] : queue[0] + high]).all():
                    j = queue.popleft()
                    one.used[i : i + high] = two.used[j : j + high] = True
                    out.append((i, j, high))
                    free = i + high
            high -= 1
    return out
