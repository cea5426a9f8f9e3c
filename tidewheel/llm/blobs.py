"""Columns of unsigned integers as one byte string, each in as few bytes a value as its range needs.

Tens of millions of small facts (a hash, a document, a position) move between stages this way: one row
for each source slice and target part, instead of one row a fact.  A column is its least value, its width,
and the bytes of what each value has above the least, lowest bytes of all values first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    n = len(columns[0])
    out = [np.array([n], "<u8").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, np.uint64)
        least = c.min() if n else np.uint64(0)
        width = (int(c.max() - least).bit_length() + 7) // 8 if n else 0
        out += [np.array([least], "<u8").tobytes(), bytes([width])]
        out.append(np.ascontiguousarray((c - least).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    while at < len(data):
        least, width = np.frombuffer(data, "<u8", 1, at)[0], data[at + 8]
        at += 9
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(full.view("<u8").reshape(n) + least)
        at += n * width
    return out


def joined(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all blobs, one after another."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(columns)]


def dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob for each value in to, with the rows of that value in their order."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    values, begins = np.unique(to[order], return_index=True)
    for v, rows in zip(values.tolist(), np.split(order, begins[1:]), strict=True):
        yield int(v), pack(*(c[rows] for c in columns))


def ordered(ids: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers as unsigned ones in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def signed(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
