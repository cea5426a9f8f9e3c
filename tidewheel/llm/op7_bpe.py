"""Byte-level BPE by merge replay over the different words of many documents, and decoding.

All different words of a batch of documents that the worker has not met lie in one linked sequence with walls
between words.  An inverted index leads from each pair of adjacent tokens to its positions.  A heap gives the pairs in
rank order; a merge visits only the positions of its pair, and enters only the pairs that it makes with
the two neighbours.  Words already replayed are kept in a bounded table.

The replay is of a batch's new words, not of the whole corpus' vocabulary at once: that would take a shuffle of all
words and a join back to each text, where a worker's table finds nearly every word after some batches, and a task needs
nothing but its own texts, so a lost one is simply run again.

Defined results: a null or empty text has no ids and decodes to no bytes; special strings are plain
text; rows of equal doc_id are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import batch, documents, slices, table
from tidewheel.llm.pieces import byte_level_pieces, vocabulary

WALL, GONE = -1, -2


class Replay:
    """ranks: from the bytes of a token to its id, lower ids merging first."""

    def __init__(self, ranks: dict[bytes, int], entries: int = 1_000_000, longest: int = 14):
        self.ranks, self.entries, self.longest = ranks, entries, longest
        self.tokens = {v: k for k, v in ranks.items()}
        self.base = max(self.tokens) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.text = {i: str(i) for i in self.tokens}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Replay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, pair: int) -> int:
        """The id that a pair of ids merges to, or -1."""
        if (found := self.pairs.get(pair)) is None:
            a, b = divmod(pair, self.base)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found

    def replay(self, words: Iterable[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        base, merged, single = self.base, self.merged, self.single
        tok: list[int] = [WALL]
        begins = []
        for w in words:
            begins.append(len(tok))
            tok += [single[b] for b in w]
            tok.append(WALL)
        size = len(tok)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        index: dict[int, list[int]] = {}
        for i in range(size - 1):
            a, b = tok[i], tok[i + 1]
            if a >= 0 and b >= 0 and merged(pair := a * base + b) >= 0:
                index.setdefault(pair, []).append(i)
        heap = [(merged(pair), pair) for pair in index]
        heapq.heapify(heap)
        while heap:
            new, pair = heapq.heappop(heap)
            if (places := index.pop(pair, None)) is None:
                continue
            a, b = divmod(pair, base)
            places.sort()
            for i in places:
                j = after[i]
                if tok[i] != a or tok[j] != b:
                    continue
                right, left = after[j], before[i]
                tok[i], tok[j], after[i], before[right] = new, GONE, right, i
                for k, x, y in ((left, tok[left], new), (i, new, tok[right])):
                    if x >= 0 and y >= 0 and (rank := merged(made := x * base + y)) >= 0:
                        if (known := index.get(made)) is None:
                            index[made] = [k]
                            heapq.heappush(heap, (rank, made))
                        else:
                            known.append(k)
        out = []
        for i in begins:
            ids = []
            while tok[i] != WALL:
                ids.append(tok[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        parts = [byte_level_pieces(t) for t in texts]
        if len(self.known) > self.entries:
            self.known.clear()
        fresh = sorted(set().union(*parts).difference(self.known))
        now = dict(zip(fresh, self.replay(w.encode() for w in fresh), strict=True))
        self.known.update((w, ids) for w, ids in now.items() if len(w) <= self.longest)
        kept = self.known
        ids_of = kept.__getitem__ if all(len(w) <= self.longest for w in fresh) else lambda w: kept.get(w) or now[w]
        return (list(chain.from_iterable(map(ids_of, p))) for p in parts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def replayer(path: str) -> Replay:
    return Replay.from_file(path)


def encode(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, schema = replayer(ranks or vocabulary("byte_bpe_50k.tiktoken")), pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in slices(batches):
            yield batch(schema, b.column(0), list(replay.encode(b.column(1).to_pylist())))

    return documents(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of every row of doc_id and ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, schema = replayer(ranks or vocabulary("byte_bpe_50k.tiktoken")), pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
        for b in slices(batches):
            yield batch(schema, b.column(0), [None if x is None else replay.decode(x) for x in b.column(1).to_pylist()])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(df: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids stay within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replayer(ranks or vocabulary("byte_bpe_50k.tiktoken"))
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for b in slices(batches):
            n, ids_hex, decoded_hex = [], [], []
            for ids in replay.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(replay.text.__getitem__, ids)).encode()).hexdigest())
                decoded_hex.append(hashlib.sha256(replay.decode(ids)).hexdigest())
            yield batch(schema, b.column(0), n, ids_hex, decoded_hex)

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
