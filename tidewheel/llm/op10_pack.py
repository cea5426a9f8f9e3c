"""Best-fit packing after a Martello-Toth reduction, on the histogram of lengths.

Documents become token counts; longer ones than a sequence are cut.  What can be packed depends on the
lengths alone, so the plan is made from their histogram, which has at most as many rows as a sequence has
tokens, whatever the number of documents:

1. Reduction.  Going down from the longest, a small set with item j is fixed for good if it dominates
   every other feasible set with j: j alone if nothing fits beside it, j and the largest k that fits if
   they fill the sequence, if no second item fits beside j, or if at most two do and no pair of them
   holds more than k.  What is fixed goes, which leaves a smaller instance, until nothing changes.
2. Best fit, longest first, on the rest, in bulk: sequences with equal room are one group.

The plan is a list of runs: items of a length numbered from k_from to k_to go, per_sequence at a time,
to consecutive sequences at one offset.  A run that touches a group at least halves its room and splits
one group at most, so there are no more than 4 * capacity * log2(2 * capacity) runs: 213 thousand for 4096
(10 MB), a bound that does not depend on the data; the runs are broadcast.  Items get their
numbers from their rank within task and length plus the counts of earlier tasks.

Defined results: a null or empty text is the end id alone; rows of equal doc_id are packed each on its
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import batch, documents, slices, table, written
from tidewheel.llm.pieces import keep_only, library, vocabulary

CAPACITY = 4096
END_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, rank long"
_RUNS = "length long, k_from long, k_to long, first_sequence long, per_sequence long, run_offset long"


class Plan:
    """runs: (length, k_from, k_to, first_sequence, per_sequence, offset); sequences: how many there are."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a length of {length} doesn't fit {capacity}")
            self.left[length] = n
        self.done = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        while self._reduce():
            pass
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, n: int, first: int, per: int, offset: int) -> None:
        k = int(self.done[length])
        self.runs.append((length, k, k + n, first, per, offset))
        self.done[length] += n
        self.left[length] -= n

    def _fix(self, lengths: tuple[int, ...], times: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, times, self.sequences, 1, offset)
            offset += length
        self.sequences += times

    def _smallest(self, few: int, without: int) -> list[int]:
        """The lengths of the few smallest items, one item of length without left out."""
        out: list[int] = []
        for length in np.flatnonzero(self.left):
            n = int(self.left[length]) - (length == without)
            out += [int(length)] * min(n, few - len(out))
            if len(out) == few:
                break
        return out

    def _reduce(self) -> bool:
        changed = False
        for j in range(self.capacity, 0, -1):
            while self.left[j]:
                room, spare = self.capacity - j, self.left.copy()
                spare[j] -= 1
                fits = np.flatnonzero(spare[: room + 1])
                if not len(fits):
                    self._fix((j,), int(self.left[j]) if 2 * j > self.capacity else 1)
                    changed = True
                    continue
                k = int(fits[-1])
                small = self._smallest(3, j)
                alone = k == room or len(small) < 2 or small[0] + small[1] > room
                if not alone and (len(small) < 3 or sum(small) > room):
                    alone = k >= self._best_pair(spare, fits, room)
                if not alone:
                    break
                self._fix((j, k), min(int(self.left[j]), int(self.left[k])) if j != k else int(self.left[j]) // 2)
                changed = True
        return changed

    @staticmethod
    def _best_pair(spare: np.ndarray, fits: np.ndarray, room: int) -> int:
        """The most that two items hold which fit together."""
        best = 0
        for p in fits:
            q = fits[: np.searchsorted(fits, room - p, "right")]
            if len(q) and q[-1] == p and spare[p] < 2:
                q = q[:-1]
            if len(q):
                best = max(best, int(p + q[-1]))
        return best

    def _best_fit(self) -> None:
        groups: dict[int, list[tuple[int, int]]] = {}
        filled = np.zeros(self.capacity + 1, bool)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            after: list[tuple[int, int, int]] = []
            for room in (np.flatnonzero(filled[length:]) + length).tolist():
                group = groups[room]
                while group and self.left[length]:
                    first, n = group.pop()
                    after += self._fill(length, room, first, n, group)
                filled[room] = bool(group)
                if not self.left[length]:
                    break
            if self.left[length]:
                n = -(-int(self.left[length]) // (self.capacity // length))
                after += self._fill(length, self.capacity, self.sequences, n, [])
                self.sequences += n
            for room, first, n in after:
                groups.setdefault(room, []).append((first, n))
                filled[room] = True

    def _fill(self, length: int, room: int, first: int, n: int, group: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Fill sequences from first as best fit does, each as far as it goes; the rest of them goes back to the group."""
        per, left = room // length, int(self.left[length])
        full, some = min(n, left // per), 0
        offset, out = self.capacity - room, []
        if full:
            self._put(length, full * per, first, per, offset)
            out.append((room - per * length, first, full))
        if full < n and (some := left - full * per):
            self._put(length, some, first + full, some, offset)
            out.append((room - some * length, first + full, 1))
        if (rest := n - full - bool(some)) > 0:
            group.append((first + full + bool(some), rest))
        return [x for x in out if x[0]]


def pieces(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document; rank counts equal lengths before it in its task (shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer or vocabulary("word_bpe_49k.json"), True)
        keep_only(lib.table)
        shard, seen, last = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("rank", pa.int64())])
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = lib.encode(text) + last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(part), shard, seen[n]))
                    seen[n] += 1
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 7))

    return documents(df).mapInArrow(run, _PIECES)


def pack(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    items = written(pieces(df, tokenizer, capacity, end_id), "pieces")
    counts = items.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = counts.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = Plan(histogram, capacity)
    if len(plan.runs) > 4 * capacity * math.log2(2 * capacity):
        raise AssertionError("more runs than the bound")
    runs = spark.createDataFrame(pd.DataFrame(plan.runs, columns=_RUNS.replace(" long", "").split(", ")).astype("int64"), _RUNS)
    k = items.join(before, ["shard", "length"]).withColumn("k", F.col("before") + F.col("rank"))
    placed = k.join(F.broadcast(runs), (k["length"] == runs["length"]) & (F.col("k") >= F.col("k_from")) & (F.col("k") < F.col("k_to")))
    n = F.col("k") - F.col("k_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        k["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(k - k_from) div per_sequence")).alias("sequence_id"),
        (F.col("run_offset") + n % F.col("per_sequence") * k["length"]).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
