"""Sorting suffixes by hashes: prefix polynomial hashes, common extensions by binary search, and a mergesort on them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASES = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15)
_BYTES = [np.random.RandomState(seed).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240601, 20240602)]
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASES[which], np.uint64), np.full(n, pow(_BASES[which], -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Bytes with prefix polynomial hashes, modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.data = data
        up, self.down = _powers(1 << max(12, len(data).bit_length()), which)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * up[:len(data)], out=self.prefix[1:])

    def names(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each [begin, end)."""
        return mixed((self.prefix[end] - self.prefix[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to `most`, the suffixes at `a` and `b` have in common: a binary search by hashes."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        pa, pb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - pa) * da == (self.prefix[b + middle] - pb) * db
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether the suffix at `a`, of that size, comes before the one at `b`; a suffix comes after its prefixes."""
        most = np.minimum(size_a, size_b)
        n = self.common(a, b, most)
        last = len(self.data) - 1
        smaller = self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)]
        return np.where(n < most, smaller, size_a < size_b)

    def sort(self, at: np.ndarray, size: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of the suffixes (at, size) within each segment; equal ones stay in their order. `segment` ascends.

        A mergesort from the bottom up, all runs of all segments at a time: an item's place in the merged run is its
        place in its own plus the number of items of the other that come before, by binary search.
        """
        order = np.arange(len(at))
        if not len(at):
            return order
        begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[begin, len(at)])
        first, length = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        local = np.arange(len(at)) - first
        width = 1
        while width < sizes.max():
            moved = np.flatnonzero(length > width)  # other segments are in order already
            f, z, r, item = first[moved], length[moved], local[moved], order[moved]
            run = r // width
            right = (run & 1).astype(bool)
            other = f + (run ^ 1) * width
            low, high = np.zeros(len(moved), np.int64), np.clip(z - (run ^ 1) * width, 0, width)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                own, partner = item[open_], order[other[open_] + middle]
                swap = right[open_]
                x, y = np.where(swap, own, partner), np.where(swap, partner, own)
                before = self.less(at[x], at[y], size[x], size[y])
                ahead = before ^ swap  # of equals the left run's come first
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            merged = order.copy()
            merged[f + (run & ~1) * width + r % width + low] = item
            order = merged
            width *= 2
        return order

    def longest(self, at: np.ndarray, size: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The longest extension that each suffix has in common with another of its segment: with a neighbour in order."""
        order = self.sort(at, size, segment)
        best = np.zeros(len(at), np.int64)
        a, b = order[:-1], order[1:]
        near = segment[a] == segment[b]
        a, b = a[near], b[near]
        n = self.common(at[a], at[b], np.minimum(size[a], size[b]))
        np.maximum.at(best, a, n)
        np.maximum.at(best, b, n)
        return best

    def repeated(self, at: np.ndarray, size: int, segment: np.ndarray) -> np.ndarray:
        """Which of the strings of `size` bytes equal an earlier one of their segment, which ascends. Neighbours that the
        hashes call equal are compared byte by byte; if one pair differs, all are named by their bytes instead."""
        sizes = np.full(len(at), size)
        order = self.sort(at, sizes, segment)
        a, b = order[:-1], order[1:]
        same = np.zeros(len(at), bool)
        near = segment[a] == segment[b]
        same[1:][near] = self.common(at[a[near]], at[b[near]], sizes[:int(near.sum())]) == size
        pairs = np.flatnonzero(same)
        view = np.lib.stride_tricks.sliding_window_view(self.data, size) if len(at) else None
        for i in range(0, len(pairs), 1 << 16):
            some = pairs[i:i + (1 << 16)]
            if (view[at[order[some]]] != view[at[order[some - 1]]]).any():
                return _repeated_bytes(view, at, segment)
        out = np.zeros(len(at), bool)
        out[order[same]] = True
        return out


def _repeated_bytes(view: np.ndarray, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    seen, out = set(), np.zeros(len(at), bool)
    for i, (s, p) in enumerate(zip(segment.tolist(), at.tolist(), strict=True)):
        key = (s, view[p].tobytes())
        out[i] = key in seen
        seen.add(key)
    return out
