"""Word shingles of whole texts as sorted 64-bit hashes, MinHash values and exact Jaccard tests, vectorised per text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_RANDOM = np.random.RandomState(20240501)
_BYTE = _RANDOM.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 20
#: Texts are hashed together up to so many characters, about.
TOGETHER = 1 << 18
#: Groups of so many sets are compared many at a time.
FEW = 8


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of each value, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of each word of the whole text, in UTF-8 bytes; A-Z count as a-z."""
    return words_of(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`words` of a text in UTF-8."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return begin, end, mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    cut = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // TOGETHER, prepend=0)).tolist() if texts else []
    return ((i, j) for i, j in zip([0, *cut], [*cut, len(texts)], strict=True) if i < j)


def joined_words(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in UTF-8 with blank lines between them, `words` of it all, and the first word of each text and of what
    would follow."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n\n".join(parts)
    begin, end, hashes = words_of(np.frombuffer(data, np.uint8))
    sizes = np.array([len(p) + 2 for p in parts], np.int64)
    return data, begin, end, hashes, np.searchsorted(begin, np.r_[0, np.cumsum(sizes)])


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` words; with fewer words, of the whole sequence as one; none without words."""
    if not len(hashes):
        return hashes
    length = min(length, len(hashes))
    # a polynomial of the run, from those of runs of half the length
    total, size = hashes, 1
    for bit in bin(length)[3:]:
        total, size = total[:len(total) - size] * _power(size) + total[size:], 2 * size
        if bit == "1":
            total, size = total[:len(total) - 1] * _BASE + hashes[size:], size + 1
    return mixed(total + np.uint64(length * int(_power(length)) % 2**64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; empty for null and for texts without words."""
    return np.unique(window_hashes(words(text)[2], length)) if text else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, shingles) of the texts, one text after the other; repeats within a text are still there."""
    counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in together(texts):
        *_, hashes, bounds = joined_words(texts[i:j])
        many = np.diff(bounds)
        size = np.where(many >= length, many - length + 1, np.minimum(many, 1))
        at = np.arange(int(size.sum())) + np.repeat(bounds[:-1] - (np.cumsum(size) - size), size)
        windows = window_hashes(hashes, length)
        some = windows[np.minimum(at, len(windows) - 1)] if len(at) else hashes[:0]
        begin = np.cumsum(size) - size
        for k in np.flatnonzero((many > 0) & (many < length)):
            some[begin[k]] = window_hashes(hashes[bounds[k]:bounds[k + 1]], length)[0]
        counts.append(size)
        found.append(some)
    return np.concatenate(counts), np.concatenate(found)


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(99)
    return random.randint(0, 2**31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), random.randint(0, 2**32, n, dtype=np.int64).astype(np.uint32)


def min_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """`n` MinHash values of a non-empty set."""
    a, b = _permutations(n)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(folded), 2048):
        np.minimum(least, (folded[i:i + 2048, None] * a + b).min(axis=0), out=least)
    return least


def segment_min_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A row of `n` MinHash values for each of the disjoint, non-empty, ascending segments of `hashes`."""
    a, b = _permutations(n)
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), n), np.uint32)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + 8192, side="right")))
        if j == i + 1:
            out[i] = min_hashes(hashes[begin[i]:end[i]], n)
        else:
            some = np.concatenate([folded[x:y] for x, y in zip(begin[i:j], end[i:j], strict=True)])
            at = np.cumsum(end[i:j] - begin[i:j]) - (end[i:j] - begin[i:j])
            out[i:j] = np.minimum.reduceat(some[:, None] * a + b, at, axis=0)
        i = j
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct sets."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True)
        return np.array([[len(sets[0]), len(both)], [len(both), len(sets[1])]])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    degree = np.diff(np.r_[begin, len(values)])
    counted = np.zeros((n, n), np.int64)
    pairs = []
    few = 8
    for k in range(2, few + 1):
        at = begin[degree == k]
        for a in range(k if len(at) else 0):
            pairs += [owner[at + a] * n + owner[at + b] for b in range(a + 1, k)]
    if pairs:
        counted += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
        counted += counted.T.copy()
    many = np.flatnonzero(degree > few)
    step = max(64, (1 << 24) // n)
    for i in range(0, len(many), step):
        some = many[i:i + step]
        column = np.repeat(np.arange(len(some)), degree[some])
        at = np.arange(len(column)) - np.repeat(np.cumsum(degree[some]) - degree[some], degree[some]) + np.repeat(begin[some], degree[some])
        dense = np.zeros((n, len(some)), np.float32)
        dense[owner[at], column] = 1
        counted += (dense @ dense.T).astype(np.int64)
    return counted


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; the diagonal is not meaningful."""
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def similar_pairs(values: np.ndarray, counts: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of one group with 100 * intersection >= percent * union, for sets given as `values` one set after the
    other (repeats allowed), `counts` of them each; no group has more than FEW sets, which follow each other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    values = values + group.astype(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15)  # of different groups: different
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]
        values, owner = values[new], owner[new]
    size = np.bincount(owner, minlength=len(counts))
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else order
    degree = np.diff(np.r_[begin, len(values)])
    both = np.zeros(len(counts) * FEW, np.int64)
    for k in range(2, FEW + 1):
        at = begin[degree == k]
        for a in range(k if len(at) else 0):
            for b in range(a + 1, k):
                both += np.bincount(owner[at + a] * FEW + owner[at + b] - owner[at + a], minlength=len(both))
    pair = np.flatnonzero(both)
    a = pair // FEW
    b = a + pair % FEW
    close = 100 * both[pair] >= percent * (size[a] + size[b] - both[pair])
    return a[close], b[close]


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each node the first node of its connected component, from a symmetric matrix."""
    first = np.full(len(linked), -1)
    for i in range(len(linked)):
        if first[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                first[front] = i
                front = linked[front].any(axis=0) & (first < 0)
    return first
