"""Hashes of any run of words of many texts at once, from prefix sums over their bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit keys."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: One random number for each byte value, in two independent tables.
_TABLES = [mix(mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * k)) * _BASE)) for k in range(2)]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base, and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, _BASE), np.full(size, _BACK)
        up[0] = down[0] = 1
        _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0], _POWERS[1]


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its smallest (leftmost of equals)."""
    n = len(h) - width + 1
    bits = np.uint64(max(1, len(h).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    # blocks of ``width``: a window is a block's suffix and the next block's prefix
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = key
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Words:
    """The words of some texts (bytes without the six white-space bytes), numbered through.

    ``first[t]`` is the number of the first word of text t, ``first[-1]`` the count of all.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        self.data = np.frombuffer(b" ".join([b" ".join(p) for p in parts if p]), np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        some = bool(len(self.data))
        self.start = np.concatenate([[0], gaps + 1]) if some else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(self.data)]]) if some else np.zeros(0, np.int64)
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, first: np.ndarray, last: np.ndarray, table: int = 0) -> np.ndarray:
        """Hashes of the words first[i] to last[i] - 1, joined by one space."""
        up, down = powers(len(self.data) + 1)
        if table not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLES[table][self.data] * up[: len(self.data)], out=sums[1:])
            self._sums[table] = sums
        a, b, sums = self.start[first], self.end[last - 1], self._sums[table]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    def cut(self, radius: int, gram: int = 2) -> np.ndarray:
        """Where content-defined paragraphs start, in order; each text begins one.

        A word begins a paragraph if the hash of the ``gram`` words from it is the smallest
        within ``radius`` words on either side (the first among equals), so that a passage
        is cut alike wherever it stands, and paragraphs have over ``radius`` words but for
        those that the end of a text cuts off.
        """
        n, texts = len(self), len(self.first) - 1
        if not n:
            return np.zeros(0, np.int64)
        of = np.repeat(np.arange(texts), np.diff(self.first))
        at = np.arange(n)
        begins = np.unique(self.first[:-1][np.diff(self.first) > 0])
        whole = np.flatnonzero((at + gram <= self.first[of + 1]) & (at > self.first[of]))
        if not len(whole):
            return begins
        slot = whole + (2 * of[whole] + 1) * radius
        h = np.full(n + (2 * texts + 1) * radius, np.iinfo(np.uint64).max, np.uint64)
        h[slot] = self.hashes(whole, whole + gram) >> np.uint64(1)
        low = lowest(h, 2 * radius + 1)
        return np.union1d(begins, whole[low[slot - radius] == slot])
