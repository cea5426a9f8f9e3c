"""Hashes of words and of runs of words, for whole slices of documents at once."""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import xxhash

from tidewheel.llm.pieces import Table, keep_only

#: Odd multipliers of two polynomial hashes, and of a bit mixer.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


@functools.cache
def hasher() -> Table:
    return Table(xxhash.xxh3_64_intdigest, entries=300_000, longest=64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def runs(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of every width neighbours, by doubling; entry i is that of h[i:i + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    left = width
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * _U(pow(base, size, 1 << 64)) + part
            done += size
        left >>= 1
        if left:
            power = power[: len(power) - size] * _U(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return out


class Slice:
    """The words of some documents, white space being space and \\t to \\r.

    hashes: of all words, document after document; begins: where each document begins, and the end.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        self.words = [(t.encode().lower() if lower else t.encode()).split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        keep_only(hasher())
        get = hasher().__getitem__
        self.hashes = np.fromiter(chain.from_iterable(map(get, w) for w in self.words), np.uint64, int(self.begins[-1]))
        self.document = np.repeat(np.arange(len(texts)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.begins[self.document]

    def whole(self, width: int) -> np.ndarray:
        """Of each position where a run of that width may begin, whether it stays in its document."""
        n = max(0, len(self.hashes) - width + 1)
        return self.place[:n] + width <= self.counts[self.document[:n]]
