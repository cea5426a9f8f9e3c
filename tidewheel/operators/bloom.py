"""The Bloom prefilter over byte windows, exact in every bit.

Sizes: m = max(64, ceil(-n ln p / ln(2)^2)), k = round(m / n * ln 2) between 1 and 7.  Positions: (h1 + i * (h2 | 1))
mod m with FNV-1a and DJB2 hashes modulo 2^64.  As 64 divides 256, for m = 64 all of this holds on 8-bit numbers.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two hashes, and bounds of the sizes.
FNV_OFFSET, FNV_PRIME, DJB2_INIT, DJB2_FACTOR = 14695981039346656037, 1099511628211, 5381, 33
MIN_BITS, MAX_HASHES, FP_RATE = 64, 7, 0.1
_MASK = (1 << 64) - 1


def sizes(n: int, fp_rate: float = FP_RATE) -> tuple[int, int]:
    """m and k for n entries."""
    n = max(n, 1)
    m = max(MIN_BITS, math.ceil(-n * math.log(fp_rate) / math.log(2) ** 2))
    return m, min(MAX_HASHES, max(1, math.floor(m / n * math.log(2) + 0.5)))


def hash_pair(data: bytes) -> tuple[int, int]:
    h1, h2 = FNV_OFFSET, DJB2_INIT
    for b in data:
        h1 = (h1 ^ b) * FNV_PRIME & _MASK
        h2 = h2 * DJB2_FACTOR + b & _MASK
    return h1, h2


@dataclasses.dataclass(frozen=True)
class Bloom:
    m: int
    k: int
    bits: frozenset[int] = frozenset()

    @classmethod
    def of(cls, entries: Iterable[bytes], window_len: int | None = None, fp_rate: float = FP_RATE) -> Bloom:
        """From rules, or from all their windows if they are longer than window_len."""
        grams = [r[i : i + w] for r in entries for w in [window_len or len(r)] for i in range(len(r) - w + 1)]
        empty = cls(*sizes(len(grams), fp_rate))
        return dataclasses.replace(empty, bits=frozenset(p for g in grams for p in empty.positions(g)))

    def positions(self, data: bytes) -> list[int]:
        h1, h2 = hash_pair(data)
        return [(h1 + i * (h2 | 1) & _MASK) % self.m for i in range(self.k)]

    def insert(self, data: bytes) -> Bloom:
        return dataclasses.replace(self, bits=self.bits | set(self.positions(data)))

    def might_contain(self, data: bytes) -> bool:
        return self.bits.issuperset(self.positions(data))

    def stats(self) -> tuple[int, int, int]:
        return self.m, self.k, len(self.bits)

    @functools.cached_property
    def _hits(self) -> np.ndarray:
        """For m = 64: whether all positions are set, by h1 and h2 modulo 64."""
        h1, h2 = np.meshgrid(np.arange(64), np.arange(64), indexing="ij")
        held = np.isin(np.arange(64), list(self.bits))
        return np.logical_and.reduce([held[(h1 + i * (h2 | 1)) % 64] for i in range(self.k)]).ravel()

    def probe(self, data: np.ndarray, width: int) -> np.ndarray:
        """Of every window of that many bytes, whether it may be contained."""
        n = max(0, len(data) - width + 1)
        kind = np.uint8 if self.m == 64 else np.uint64
        h1, h2 = np.full(n, FNV_OFFSET & (0xFF if kind is np.uint8 else _MASK), kind), np.full(n, DJB2_INIT & (0xFF if kind is np.uint8 else _MASK), kind)
        prime, factor = kind(FNV_PRIME & 0xFF) if kind is np.uint8 else kind(FNV_PRIME), kind(DJB2_FACTOR)
        for j in range(width):
            b = data[j : j + n].astype(kind, copy=False)
            h1 ^= b
            h1 *= prime
            h2 *= factor
            h2 += b
        if kind is np.uint8:
            return self._hits[(h1 & 63).astype(np.uint16) << 6 | (h2 & 63)]
        held = np.isin(np.arange(self.m), list(self.bits))
        ok = np.ones(n, bool)
        for i in range(self.k):
            ok &= held[((h1 + kind(i) * (h2 | kind(1))) % kind(self.m)).astype(np.int64)]
        return ok


def candidate_counts(groups: list[tuple[Bloom, int]]):
    """A pandas UDF on normalised payloads (binary): how many windows of all groups pass their filters."""

    @F.pandas_udf("long")
    def count(payloads: pd.Series) -> pd.Series:
        data = [b"" if p is None else p for p in payloads]
        sizes_ = np.array([len(d) for d in data])
        flat, begins = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(sizes_)])
        total = np.zeros(len(data), np.int64)
        owner = np.repeat(np.arange(len(data)), sizes_)
        for bloom, width in groups:
            at = np.flatnonzero(bloom.probe(flat, width))
            at = at[at + width <= begins[owner[at] + 1]] if len(at) else at  # windows end with their payload
            total += np.bincount(owner[at], minlength=len(data))
        return pd.Series(total)

    return count


def candidate_positions(bloom: Bloom, width: int):
    """A pandas UDF on normalised payloads (binary): where windows begin that pass the filter."""

    @F.pandas_udf("array<long>")
    def positions(payloads: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(bloom.probe(np.frombuffer(p or b"", np.uint8), width)).tolist() for p in payloads])

    return positions


def probe_sql(window_bytes: Column, bloom: Bloom) -> Column:
    """The same test on an array of byte values, in SQL expressions; for m = 64 only."""
    if bloom.m != 64:
        raise ValueError("the arithmetic modulo 64 is exact for m = 64 only")
    h1 = F.aggregate(window_bytes, F.lit(FNV_OFFSET % 64), lambda h, b: (h.bitwiseXOR(b) * (FNV_PRIME % 64)) % 64)
    h2 = F.aggregate(window_bytes, F.lit(DJB2_INIT % 64), lambda h, b: (h * DJB2_FACTOR + b) % 64)
    held = F.array(*[F.lit(b) for b in sorted(bloom.bits)] or [F.lit(-1)])
    # a let: both hashes are computed once
    pair = F.array(F.struct(h1.alias("h1"), h2.alias("h2")))
    return F.forall(pair, lambda p: F.forall(F.sequence(F.lit(0), F.lit(bloom.k - 1)), lambda i: F.array_contains(held, ((p["h1"] + i * p["h2"].bitwiseOR(F.lit(1))) % 64).cast("int"))))
